"""Extra columns with clashing names, very long texts, nulls and repeated rows: the same results for every operator."""

import pytest
from pyspark.sql import functions as F

from equiaudit.llm.exact_dedup import exact_dedup
from equiaudit.llm.langid import language_id
from equiaudit.llm.line_dedup import line_counts
from equiaudit.llm.mixture import mixture
from equiaudit.llm.near_dedup import near_duplicates
from equiaudit.llm.packing import pack
from equiaudit.llm.substring_dedup import remove_repeats
from equiaudit.llm.toxicity import toxicity

CLASHING = ("id", "row", "of", "n", "size", "words", "part", "start", "length", "source_size", "target", "taken", "score",
            "lang_pred", "held_out", "kept", "keep_id", "group_size", "text_sha256", "n_words", "component_id", "label",
            "predicted", "key", "ids", "local", "offset", "sequence_id", "line", "no", "at", "toxic")
OPERATORS = {
    "language_id": language_id, "pack": pack, "mixture": mixture, "exact_dedup": exact_dedup, "line_counts": line_counts,
    "near_duplicates": near_duplicates, "remove_repeats": remove_repeats}


@pytest.fixture(scope="module")
def odd(docs_of, prose):
    long = "\n".join(prose(15, i) for i in range(4_000))
    rows = [(i, prose(40, i), f"l{i % 2}", f"s{i % 3}") for i in range(40)]
    rows += [(50, long, "l0", "s0"), (51, long.upper(), "l0", "s1"), (52, None, None, None), (53, "", "l1", "s0"),
             (54, " \t\n", None, "s2"), (3, rows[3][1], "l1", "s0"), (None, prose(12, 90), "l0", "s1"),
             (55, "word " * 60_000, "l1", None)]
    return docs_of(*rows).cache()


def _rows(df):
    return sorted(str(r.asDict()) for r in df.collect())


@pytest.mark.parametrize("name", list(OPERATORS))
def test_clashing_columns_change_nothing(odd, name):
    plain = OPERATORS[name](odd)
    clash = OPERATORS[name](odd.withColumns({c: F.lit("clash") for c in CLASHING}))
    assert _rows(clash.select(*plain.columns)) == _rows(plain)
    if name != "pack":
        assert plain.count() == odd.count()
    else:  # every document is there as a whole, whatever it is cut into
        assert plain.groupBy("doc_id").agg((F.sum("length") % F.max("doc_tokens")).alias("d")).where("d != 0").count() == 0
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_toxicity_with_clashing_columns(spark, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    plain = toxicity(odd, labels)
    clash = toxicity(odd.withColumns({c: F.lit("clash") for c in CLASHING}), labels.withColumns(
        {c: F.lit("clash") for c in ("text", "label", "score", "n")}))
    keep = ["doc_id", "held_out", "score", "predicted"]
    assert _rows(clash.select(*keep)) == _rows(plain.select(*keep)) and plain.count() == odd.count()


def test_a_sample_of_a_table_of_any_size(spark):
    """The share of a sample is a real number, so it does not fall to nothing."""
    from equiaudit.llm.common import training_sample

    rows = spark.range(3_000_000).withColumnRenamed("id", "doc_id")
    got = training_sample(rows, "doc_id", 4_000, total=5_000_000_000).count()
    assert got <= 20  # 2.4 are expected of these rows
    assert abs(training_sample(rows, "doc_id", 400_000, total=300_000_000).count() - 4_000) < 500
    assert training_sample(rows, "doc_id", 10, total=5).count() == 3_000_000


def test_slices_by_bytes():
    import pyarrow as pa

    from equiaudit.llm.common import byte_slices

    texts = ["a" * 10, None, "b" * 5000, "", "c" * 30, "d" * 30, "é" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    got = [s.column(0).to_pylist() for s in byte_slices(batch, 1, size=64, rows=3)]
    assert [i for s in got for i in s] == list(range(7)) and all(len(s) <= 3 for s in got)
    assert [2] in got or any(s[-1] == 2 and len(s) <= 3 for s in got)
    assert list(byte_slices(batch.slice(0, 0), 1)) == []
