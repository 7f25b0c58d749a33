import hashlib
import string

from equiaudit.llm.exact_dedup import exact_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t in rows:
        own = groups[(t or "").translate(LOWER)]
        keep = max((x for x in own if x is not None), default=None)
        digest = hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()
        out.append((i, keep, len(own), i == keep, digest))
    return sorted(out, key=str)


def run(df, **options):
    return sorted((tuple(r) for r in exact_dedup(df, **options).collect()), key=str)


def test_cases(docs_of):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "ab"), (None, "alone"), (7, "x" * 200_000),
            (8, "X" * 200_000), (9, "once"), (9, "once")]
    assert run(docs_of(*rows)) == brute(rows)


def test_heavy_digest_takes_the_broadcast_path(docs_of):
    rows = [(i, "hot" if i % 3 else f"text {i // 6}") for i in range(600)]
    assert run(docs_of(*rows), support=0.1) == brute(rows)
    assert run(docs_of(*rows), support=0.9) == brute(rows)  # nothing is frequent enough: all are shuffled


def test_empty_and_extra_columns(spark, docs_of):
    assert run(docs_of()) == []
    df = docs_of((1, "a"), (2, "A")).withColumnRenamed("lang", "keep_id").withColumnRenamed("source", "text_sha256")
    assert [r[1] for r in run(df)] == [2, 2]


def test_no_python_in_the_plan(docs_of):
    plan = exact_dedup(docs_of((1, "a"), (2, "a")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
