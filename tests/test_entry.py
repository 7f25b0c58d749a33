"""Driver contract: entry, queries and oracle keys."""

import re

import __spark_entry__ as E

from paths import SF0001


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"attribute", "group", "metric", "value", "difference", "ratio", "flag"}
    assert df.count() > 0


def audit(names):
    """The audit's own queries; the training-data operators have tests of their own."""
    return {n for n in names if n != "pipeline" and not re.match(r"op\d+_", n)}


def test_oracle_keys_are_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert audit(set(q) - set(o)) == {"report_json", "train_score", "proxy_detection", "diagnostics_status",
                                      "proxy_by_run", "diagnostics_by_run"}


def test_fast_queries_run_on_smallest_tables(spark):
    slow = {"train_score", "proxy_detection", "diagnostics_status"}
    for name in audit(E.queries()) - slow:
        df = E.queries()[name](spark, SF0001)
        assert len(df.columns) > 1 and df.count() > 0, name
