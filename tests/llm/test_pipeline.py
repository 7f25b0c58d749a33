import random
import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import corpus_pipeline as cp
import pytest

from equiaudit.llm.sql import SQL

ROOT = Path(__file__).resolve().parents[2]


def test_registered():
    names = [m[1] for n in entry.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(map(int, names)) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(SQL) <= set(entry.queries())
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixture", "packing"]


def test_stages_step_by_step(spark, docs_of, prose, tmp_path):
    rows = [(i, "\n".join(prose(60, 50 * i + k) for k in range(3)), "en", f"s{i % 3}") for i in range(60)]
    copy = (100, rows[0][1], "en", "s0")
    near = (101, "\n".join(" ".join(w + ("qqq" if k == 7 else "") for k, w in enumerate(x.split()))
                           for x in rows[1][1].split("\n")), "en", "s1")
    junk = [(200, None, None, None), (201, "", "en", "s"), (202, "12 34", "en", "s")]
    docs = docs_of(*rows, copy, near, *junk)
    at = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = at[name] = spark.read.parquet(str(tmp_path / name))
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in at.items()}
    plain = {i for i, *_ in rows}
    assert ids["language_id"] == plain | {100, 101}
    assert ids["line_dedup"] == plain | {101}  # every line of 100 is one of 0
    assert ids["near_dedup"] == plain
    assert all(at[k].columns == ["doc_id", "text", "lang", "source", "n_chars"] for k in list(at)[:-1])
    assert at["packing"].agg({"sequence_id": "max"}).first()[0] >= 0


@pytest.mark.parametrize("languages", [0, 1, 4, 20])
def test_clean_short_texts_pass_with_any_number_of_languages(spark, docs_of, tmp_path, languages):
    rnd = random.Random(languages)
    rows = [(i, " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(20)), f"l{i % languages}" if languages else None)
            for i in range(60)]
    asked = [(100, "日本", None), (101, "zzz", None), (102, "hab", None), (103, "É", None)]
    junk = [(200, None, None), (201, "", None), (202, "12 ½ _!?", None), (203, None, "l0" if languages else None)]
    got = cp.language(spark, docs_of(*rows, *asked, *junk), str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == [*range(60), 100, 101, 102, 103] and len(got.columns) == 5


@pytest.mark.parametrize("languages", [1, 4, 20])
def test_noise_goes_and_missing_languages_are_filled(spark, docs_of, tmp_path, languages):
    """Each language has words of its own; noise has the letters of none."""
    rnd = random.Random(languages)
    words = [["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 8))) for _ in range(80)] for _ in range(languages)]
    rows = [(i, " ".join(rnd.choices(words[i % languages], k=30)), f"l{i % languages}") for i in range(300 * languages)]
    noise = [(10_000 + i, " ".join("".join(rnd.choices("qxzvkw", k=6)) for _ in range(40)), None) for i in range(5)]
    foreign = (11_000, " ".join("".join(rnd.choices("жщлюяэф", k=6)) for _ in range(40)), None)
    short = (12_000, "qxzv kwq", None)
    unlabelled = [(13_000 + k, " ".join(rnd.choices(words[k], k=30)), None) for k in range(languages)]
    got = {r["doc_id"]: r["lang"] for r in cp.language(
        spark, docs_of(*rows, *noise, foreign, short, *unlabelled), str(tmp_path)).collect()}
    assert set(got) == {i for i, *_ in rows} | {12_000} | {i for i, *_ in unlabelled}
    assert all(got[i] == lang for i, _, lang in rows)
    assert all(got[13_000 + k] == f"l{k}" for k in range(languages))


def test_short_lines_repeated(spark, docs_of, prose, tmp_path):
    docs = docs_of((1, f"Les.\n{prose(30, 1)}"), (2, f"{prose(30, 2)}\nLes.\n\nLes"), (3, "Les."))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.lines(spark, docs, str(tmp_path)).collect()}
    left = f"{prose(30, 2)}\n\nLes"
    assert got == {1: (f"Les.\n{prose(30, 1)}",) + (len(prose(30, 1)) + 5,), 2: (left, len(left))}


def test_empty_documents(spark, docs_of, tmp_path):
    docs = docs_of()
    for name, stage in cp.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_entry_without_the_subpackage(tmp_path):
    """A copy without the folders and the pipeline still imports, and lists the other queries."""
    for x in ROOT.iterdir():
        if x.name not in ("equiaudit", "corpus_pipeline.py", ".git", "tests"):
            (tmp_path / x.name).symlink_to(x)
    (tmp_path / "equiaudit").mkdir()
    for x in (ROOT / "equiaudit").iterdir():
        if x.name not in ("llm", "__pycache__"):
            (tmp_path / "equiaudit" / x.name).symlink_to(x)
    entry_file = tmp_path / "__spark_entry__.py"
    text = entry_file.read_text()
    entry_file.unlink()
    entry_file.write_text(text)
    code = "import __spark_entry__ as e; q = e.queries(); print('fairness_report' in q, 'op1_warc' in q)"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "False"], out.stderr[-500:]


def test_every_labelled_document_counts_for_the_language(spark, docs_of, tmp_path, monkeypatch):
    """The model learns from all labelled rows of three quarters, its limits come from all of the other quarter."""
    from equiaudit.llm.common import held_out

    seen = {}

    def recorded(name, fn):
        def call(rows, *a, **k):
            seen[name] = rows.count()
            return fn(rows, *a, **k)
        return call

    for name in ("train", "least_known_shares"):
        monkeypatch.setattr(cp, name, recorded(name, getattr(cp, name)))
    docs = docs_of(*[(i, "one two three", "en") for i in range(20_000)], (20_000, "one two three", None))
    aside = docs.where(held_out("doc_id", 4, 2) & (docs.lang == "en")).count()
    assert cp.language(spark, docs, str(tmp_path)).count() == 20_001
    assert seen == {"train": 20_000 - aside, "least_known_shares": aside}
