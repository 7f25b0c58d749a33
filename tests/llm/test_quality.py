import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from equiaudit.llm.quality import BASE, RULES, cascade_order, measures, quality_cascade

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {p + k for ps in at.values() if len(ps) > 1 for p in ps for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines)}


def check(docs_of, texts):
    got = {r["doc_id"]: r for r in measures(docs_of(*enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        for k, v in brute(t).items():
            assert got[i][k] == v, (t, k)


def test_cases(docs_of):
    loop = " ".join(f"w{i}" for i in range(12))
    check(docs_of, [None, "", " \t\n\x0b\x0c\r ", "a b", loop, f"{loop} {loop}", f"{loop} x {loop} {loop}", "a " * 50, "é ü x y\n" * 9,
                    "l1\nl1\n\nl1\r\n l1", "# * $ % & | < >", "w " * 30_000, loop + " " + " ".join(loop.split()[2:])])


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_random(docs_of, seed):
    rnd = random.Random(seed)
    check(docs_of, ["".join(rnd.choice("ab \n\t#é") for _ in range(rnd.randint(0, 120))) for _ in range(40)])


def test_verdict_does_not_depend_on_the_order(docs_of, prose):
    texts = [prose(40, i) for i in range(20)] + [prose(40, 50) + " ####" * 20, "x y", None, "12 " * 30 + prose(9, 3)]
    df = docs_of(*enumerate(texts))
    one = {r["doc_id"]: r["kept"] for r in quality_cascade(df).collect()}
    assert one == {r["doc_id"]: r["kept"] for r in quality_cascade(df, rules=RULES[::-1]).collect()}
    assert all(one[i] for i in range(20)) and not any(one[i] for i in range(20, 24))


def test_order_by_rejections_per_cost(docs_of, prose):
    texts = [prose(30, i) + (" #$%&" * 10 if i % 2 else "") for i in range(60)]
    ordered = cascade_order(docs_of(*enumerate(texts)), RULES)
    assert ordered[0][0].name == "symbols" and ordered[0][1] == 0.5
    assert all(share == 0 for _, share, _ in ordered[1:])  # among the rows that are left
    assert [r for r, _, _ in cascade_order(docs_of(), RULES)] == list(RULES)
    assert {r.name for r in BASE} == {"few_words", "repeated_windows"}


def test_costly_conditions_are_inside_their_branches(docs_of, prose):
    """The words of a row are looked at letter by letter only where no earlier rule has rejected it."""
    out = quality_cascade(docs_of((1, prose(30, 1))))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("p{L}") == 1
    line = next(x for x in plan.split("\n") if "p{L}" in x)
    assert line.index("CASE WHEN") < line.index("p{L}")  # no measure of its own
    assert "words" not in out.columns


def test_other_columns_and_long_texts(docs_of, prose):
    from pyspark.sql import functions as F

    text = "\n".join(prose(12, i) for i in range(8_000))
    df = docs_of((1, text), (None, prose(30, 2)), (1, text)).withColumns(
        {"n_words": F.lit("clash"), "words": F.lit("clash"), "kept": F.lit(0)})
    got = [r for r in quality_cascade(df).collect() if r.doc_id == 1]
    assert len(got) == 2 and got[0] == got[1] and got[0].n_words == 96_000 and got[0].kept
