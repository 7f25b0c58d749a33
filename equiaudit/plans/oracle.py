"""DuckDB-runnable SQL for every registered query (the correctness oracle).

Views ``region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations`` are assumed registered.
Column names match the Spark results exactly.
"""

from __future__ import annotations

SCORED = """
scored0 AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_returnflag = 'R' THEN 'good' ELSE 'bad' END AS y_true,
         CAST((l_orderkey*7 + l_partkey*13 + l_linenumber*31) % 700
              + CASE WHEN l_returnflag = 'R' THEN 200 ELSE 0 END
              + CASE WHEN c_mktsegment = 'BUILDING' THEN 90 ELSE 0 END AS DOUBLE)
           / CAST(1000 AS DOUBLE) AS y_score,
         c_mktsegment AS segment, o_orderpriority AS priority, l_linestatus AS status,
         CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'small'
              WHEN l_quantity > 10 AND l_quantity <= 25 THEN 'medium'
              WHEN l_quantity > 25 AND l_quantity <= 40 THEN 'large'
              WHEN l_quantity > 40 AND l_quantity <= 50 THEN 'bulk' END AS size_group,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
         o_orderstatus, o_orderpriority, o_totalprice, c_acctbal, c_mktsegment, c_nationkey,
         CAST(year(o_orderdate) AS VARCHAR) AS run_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
scored AS (
  SELECT *, CASE WHEN y_score >= CAST(0.5 AS DOUBLE) THEN 'good' ELSE 'bad' END AS y_pred FROM scored0
),
long AS (
  SELECT run_id, 'segment' AS attribute, segment AS "group", y_true, y_pred, y_score FROM scored
  UNION ALL SELECT run_id, 'priority', priority, y_true, y_pred, y_score FROM scored
  UNION ALL SELECT run_id, 'status', status, y_true, y_pred, y_score FROM scored
  UNION ALL SELECT run_id, 'size_group', size_group, y_true, y_pred, y_score FROM scored
)"""

COUNTS = """
counts AS (
  SELECT attribute, "group",
         CAST(SUM(CASE WHEN y_true = 'good' AND y_pred = 'good' THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(SUM(CASE WHEN y_true <> 'good' AND y_pred = 'good' THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(SUM(CASE WHEN y_true = 'good' AND y_pred <> 'good' THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(SUM(CASE WHEN y_true <> 'good' AND y_pred <> 'good' THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM long WHERE "group" IS NOT NULL GROUP BY attribute, "group"
),
rates AS (
  SELECT attribute, "group", tp + fp + fn + tn AS n,
         CASE WHEN tp + fp + fn + tn > 0 THEN CAST(tp + fp AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE)
              ELSE CAST(0 AS DOUBLE) END AS selection_rate,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE)
              ELSE CAST(0 AS DOUBLE) END AS true_positive_rate,
         CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / CAST(fp + tn AS DOUBLE)
              ELSE CAST(0 AS DOUBLE) END AS false_positive_rate
  FROM counts
),
rl AS (
  SELECT attribute, "group", 'selection_rate' AS metric, selection_rate AS value FROM rates
  UNION ALL SELECT attribute, "group", 'true_positive_rate', true_positive_rate FROM rates
  UNION ALL SELECT attribute, "group", 'false_positive_rate', false_positive_rate FROM rates
),
disp AS (
  SELECT attribute, metric, MAX(value) - MIN(value) AS difference,
         CASE WHEN MAX(value) > 0 THEN MIN(value) / MAX(value) END AS ratio
  FROM rl GROUP BY attribute, metric
),
flags AS (
  SELECT attribute, metric, difference, ratio,
         COALESCE(difference > CAST(0.05 AS DOUBLE), false) AS flag
  FROM disp
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


BASE = _with(SCORED, COUNTS)

SQL: dict[str, str] = {}

SQL["group_sizes"] = _with(SCORED) + """
SELECT attribute, COALESCE("group", 'nan') AS "group", CAST(COUNT(*) AS BIGINT) AS n
FROM long GROUP BY attribute, "group"
"""

SQL["confusion_by_group"] = BASE + 'SELECT attribute, "group", tp, fp, fn, tn FROM counts'

SQL["group_rates"] = BASE + "SELECT * FROM rates"

SQL["disparity"] = BASE + "SELECT attribute, metric, difference, ratio FROM disp"

SQL["disparity_flags"] = BASE + "SELECT attribute, metric, difference, flag FROM flags"

SQL["fairness_report"] = BASE + """
SELECT rl.attribute, rl."group", rl.metric, rl.value, f.difference, f.ratio, f.flag
FROM rl JOIN flags f ON rl.attribute = f.attribute AND rl.metric = f.metric
"""

SQL["findings"] = BASE + """
SELECT attribute, metric, difference,
       CAST(CASE attribute WHEN 'segment' THEN 0 WHEN 'priority' THEN 1 WHEN 'status' THEN 2
            WHEN 'size_group' THEN 3 END AS INTEGER) AS attribute_pos,
       CAST(CASE metric WHEN 'selection_rate' THEN 0 WHEN 'true_positive_rate' THEN 1
            WHEN 'false_positive_rate' THEN 2 END AS INTEGER) AS metric_pos
FROM flags WHERE flag
"""

SQL["accuracy"] = _with(SCORED) + """
SELECT AVG(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS accuracy, CAST(COUNT(*) AS BIGINT) AS n FROM scored
"""

SQL["rates_pivot"] = BASE + 'SELECT attribute, "group", selection_rate, true_positive_rate, false_positive_rate FROM rates'

SQL["small_groups"] = _with(SCORED) + """
SELECT attribute, COALESCE("group", 'nan') AS "group", CAST(COUNT(*) AS BIGINT) AS n, COUNT(*) < 30 AS is_small
FROM long GROUP BY attribute, "group"
"""

SQL["largest_groups"] = _with(SCORED) + """, sizes AS (
  SELECT attribute, COALESCE("group", 'nan') AS "group", CAST(COUNT(*) AS BIGINT) AS n FROM long GROUP BY attribute, "group"
)
SELECT attribute, CAST(rank AS INTEGER) AS rank, "group", n FROM (
  SELECT attribute, "group", n, ROW_NUMBER() OVER (PARTITION BY attribute ORDER BY n DESC, "group" ASC) AS rank FROM sizes
) t WHERE rank <= 2
"""

# ---------------------------------------------------------------- thresholds, AUC

CUTS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)

_cut_counts = "\n  UNION ALL ".join(
    f"""SELECT attribute, "group", CAST({t} AS DOUBLE) AS threshold,
         CAST(SUM(CASE WHEN y_true = 'good' AND y_score >= CAST({t} AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(SUM(CASE WHEN y_true <> 'good' AND y_score >= CAST({t} AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(SUM(CASE WHEN y_true = 'good' AND NOT (y_score >= CAST({t} AS DOUBLE)) THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(SUM(CASE WHEN y_true <> 'good' AND NOT (y_score >= CAST({t} AS DOUBLE)) THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM long WHERE "group" IS NOT NULL GROUP BY attribute, "group\""""
    for t in CUTS
)

SWEEP = _with(SCORED) + f""", tc AS (
  {_cut_counts}
), tr AS (
  SELECT attribute, "group", threshold,
         CAST(tp + fp AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) AS selection_rate,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS true_positive_rate,
         CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / CAST(fp + tn AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS false_positive_rate
  FROM tc
), tl AS (
  SELECT attribute, threshold, 'selection_rate' AS metric, selection_rate AS value FROM tr
  UNION ALL SELECT attribute, threshold, 'true_positive_rate', true_positive_rate FROM tr
  UNION ALL SELECT attribute, threshold, 'false_positive_rate', false_positive_rate FROM tr
), sweep AS (
  SELECT attribute, threshold, metric, MAX(value) - MIN(value) AS difference,
         CASE WHEN MAX(value) > 0 THEN MIN(value) / MAX(value) END AS ratio
  FROM tl GROUP BY attribute, threshold, metric
)
"""

SQL["threshold_sensitivity"] = SWEEP + "SELECT * FROM sweep"

SQL["best_threshold"] = SWEEP + """, wide AS (
  SELECT attribute, threshold,
         MAX(CASE WHEN metric = 'true_positive_rate' THEN difference END) AS tpr_difference,
         MAX(CASE WHEN metric = 'false_positive_rate' THEN difference END) AS fpr_difference
  FROM sweep GROUP BY attribute, threshold
)
SELECT attribute, threshold, tpr_difference, fpr_difference FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY attribute ORDER BY tpr_difference, threshold) AS rn FROM wide
) t WHERE rn = 1
"""

_AUC_TAIL = """
SELECT {keys}
       CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0
            THEN CAST(SUM(pos * (2 * neg_before + neg)) AS DOUBLE) / CAST(2 * SUM(pos) * SUM(neg) AS DOUBLE) END AS auc,
       CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg
FROM rt {group_by}
"""

SQL["auc"] = _with(SCORED) + """, ps AS (
  SELECT y_score AS score, SUM(CASE WHEN y_true = 'good' THEN 1 ELSE 0 END) AS pos,
         SUM(CASE WHEN y_true = 'good' THEN 0 ELSE 1 END) AS neg
  FROM scored WHERE y_score IS NOT NULL AND NOT isnan(y_score) GROUP BY y_score
), rt AS (
  SELECT *, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
  FROM ps
)""" + _AUC_TAIL.format(keys="", group_by="")

SQL["risk_band"] = _with(SCORED) + """, ps AS (
  SELECT attribute, "group", y_score AS score, SUM(CASE WHEN y_true = 'good' THEN 1 ELSE 0 END) AS pos,
         SUM(CASE WHEN y_true = 'good' THEN 0 ELSE 1 END) AS neg
  FROM long WHERE "group" IS NOT NULL AND y_score IS NOT NULL GROUP BY attribute, "group", y_score
), rt AS (
  SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY attribute, "group" ORDER BY score
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
  FROM ps
), a AS (""" + _AUC_TAIL.format(keys='attribute, "group",', group_by='GROUP BY attribute, "group"') + """)
SELECT attribute, "group", auc,
       CASE WHEN auc IS NULL THEN NULL WHEN auc >= CAST(0.8 AS DOUBLE) THEN 'high'
            WHEN auc >= CAST(0.65 AS DOUBLE) THEN 'moderate' ELSE 'low' END AS risk_level
FROM a
"""

# ---------------------------------------------------------------- cardinality, slices

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            "o_orderstatus", "o_orderpriority", "o_totalprice", "c_acctbal", "c_mktsegment", "c_nationkey")
NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "c_acctbal", "c_nationkey")
CATEGORICAL = ("l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "c_mktsegment")
SLICE_COLS = ("l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "c_mktsegment")

SQL["column_cardinality"] = _with(SCORED) + ", card AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS position, COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
    f" AS n_distinct FROM scored" for i, c in enumerate(FEATURES)
) + """
)
SELECT feature, CAST(position AS INTEGER) AS position, CAST(n_distinct AS BIGINT) AS n_distinct
FROM card WHERE n_distinct <= 8
"""

SQL["slice_scan"] = _with(SCORED) + ", sl AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS pos, CAST({c} AS VARCHAR) AS value, y_true, y_pred FROM scored"
    for i, c in enumerate(SLICE_COLS)
) + """
), c AS (
  SELECT feature, pos, value,
         SUM(CASE WHEN y_true = 'good' AND y_pred = 'good' THEN 1 ELSE 0 END) AS tp,
         SUM(CASE WHEN y_true <> 'good' AND y_pred = 'good' THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN y_true = 'good' AND y_pred <> 'good' THEN 1 ELSE 0 END) AS fn,
         SUM(CASE WHEN y_true <> 'good' AND y_pred <> 'good' THEN 1 ELSE 0 END) AS tn
  FROM sl WHERE value IS NOT NULL GROUP BY feature, pos, value
), r AS (
  SELECT feature, pos, value, CAST(tp + fp + fn + tn AS BIGINT) AS n,
         CAST(tp + fp AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) AS selection_rate,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS true_positive_rate,
         CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / CAST(fp + tn AS DOUBLE) END AS false_positive_rate
  FROM c WHERE tp + fp + fn + tn >= 10
), ranked AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY selection_rate DESC, n DESC, pos, value) AS INTEGER) AS rank, * FROM r
)
SELECT rank, feature, value, n, selection_rate, true_positive_rate, false_positive_rate FROM ranked WHERE rank <= 20
"""

# ---------------------------------------------------------------- feature shift (attribute: segment)

TWO_GROUPS = """, gs AS (
  SELECT COALESCE(segment, 'nan') AS g, COUNT(*) AS n FROM scored GROUP BY 1
), top2 AS (
  SELECT g, ROW_NUMBER() OVER (ORDER BY n DESC, g) AS r FROM gs
), ga AS (SELECT g FROM top2 WHERE r = 1), gb AS (SELECT g FROM top2 WHERE r = 2),
two AS (
  SELECT s.*, t.r, t.g AS grp FROM scored s JOIN top2 t ON COALESCE(s.segment, 'nan') = t.g WHERE t.r <= 2
)"""

SQL["numeric_shift"] = _with(SCORED) + TWO_GROUPS + ", m AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS position, AVG(CASE WHEN r = 1 THEN CAST({c} AS DOUBLE) END) AS mean_a, "
    f"AVG(CASE WHEN r = 2 THEN CAST({c} AS DOUBLE) END) AS mean_b FROM two" for i, c in enumerate(NUMERIC)
) + """
), d AS (
  SELECT feature, position, mean_a, mean_b, ABS(mean_a - mean_b) AS abs_mean_diff FROM m
), ranked AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY abs_mean_diff DESC NULLS FIRST, position) AS INTEGER) AS rank, * FROM d
)
SELECT rank, feature, (SELECT g FROM ga) AS group_a, (SELECT g FROM gb) AS group_b,
       ROUND(mean_a, 6) AS mean_a, ROUND(mean_b, 6) AS mean_b, ROUND(abs_mean_diff, 6) AS abs_mean_diff
FROM ranked WHERE rank <= 10
"""

TOP_VALUES = _with(SCORED) + TWO_GROUPS + ", tl AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT grp AS \"group\", '{c}' AS feature, {i} AS position, COALESCE(CAST({c} AS VARCHAR), 'nan') AS value FROM two"
    for i, c in enumerate(CATEGORICAL)
) + """
), cnt AS (
  SELECT "group", feature, position, value, COUNT(*) AS cnt FROM tl GROUP BY "group", feature, position, value
), sh AS (
  SELECT "group", feature, position, value,
         CAST(cnt AS DOUBLE) / CAST(SUM(cnt) OVER (PARTITION BY "group", feature) AS DOUBLE) AS share,
         ROW_NUMBER() OVER (PARTITION BY "group", feature ORDER BY cnt DESC, value) AS rank
  FROM cnt
), top5 AS (SELECT * FROM sh WHERE rank <= 5)
"""

SQL["top_values"] = TOP_VALUES + """
SELECT feature, "group", value, share, CAST(rank AS INTEGER) AS rank FROM top5
"""

SQL["categorical_shift"] = TOP_VALUES + """, pv AS (
  SELECT feature, position, value,
         COALESCE(MAX(CASE WHEN "group" = (SELECT g FROM ga) THEN share END), 0) AS pa,
         COALESCE(MAX(CASE WHEN "group" = (SELECT g FROM gb) THEN share END), 0) AS pb
  FROM top5 GROUP BY feature, position, value
), tvd AS (
  SELECT feature, position, 0.5 * SUM(ABS(pa - pb)) AS tvd FROM pv GROUP BY feature, position
), ranked AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY tvd DESC, position) AS INTEGER) AS rank, * FROM tvd
)
SELECT rank, feature, (SELECT g FROM ga) AS group_a, (SELECT g FROM gb) AS group_b,
       ROUND(CAST(tvd AS DOUBLE), 9) AS total_variation_distance
FROM ranked WHERE rank <= 10
"""

# ---------------------------------------------------------------- derivations

SQL["label_map"] = """
SELECT o_orderkey, CASE CAST(o_orderstatus AS VARCHAR) WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' END AS label
FROM orders
"""

SQL["derive_map"] = """
SELECT c_custkey, CASE CAST(c_mktsegment AS VARCHAR) WHEN 'AUTOMOBILE' THEN 'industry' WHEN 'BUILDING' THEN 'industry'
       WHEN 'MACHINERY' THEN 'industry' WHEN 'HOUSEHOLD' THEN 'consumer' END AS sector
FROM customer
"""

SQL["derive_bin"] = """
SELECT o_orderkey,
       CASE WHEN o_totalprice > 0 AND o_totalprice <= 50000 THEN 'low'
            WHEN o_totalprice > 50000 AND o_totalprice <= 150000 THEN 'mid'
            WHEN o_totalprice > 150000 AND o_totalprice <= 300000 THEN 'high'
            WHEN o_totalprice > 300000 AND o_totalprice <= 500000 THEN 'top' END AS price_band
FROM orders
"""

SQL["positive_flag"] = """
SELECT event_id, CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS is_positive FROM events
"""

SQL["coerce_numeric"] = """
SELECT event_id, raw, TRY_CAST(raw AS DOUBLE) AS value FROM (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS raw
  FROM events
) t
"""

SQL["na_tokens"] = """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN NULL ELSE o_orderpriority END AS priority
FROM orders
"""

SQL["label_values"] = """
SELECT DISTINCT 'l_returnflag' AS "column", l_returnflag AS value FROM lineitem WHERE l_returnflag IS NOT NULL
UNION ALL
SELECT DISTINCT 'l_linestatus', l_linestatus FROM lineitem WHERE l_linestatus IS NOT NULL
"""

# ---------------------------------------------------------------- profiles, imputers, split

ORDERS_N = """
orders_n AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice_n,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority_n
  FROM orders
)"""

SQL["numeric_profile"] = _with(ORDERS_N) + """, v AS (
  SELECT 'o_totalprice_n' AS feature, CAST(o_totalprice_n AS DOUBLE) AS value FROM orders_n WHERE o_totalprice_n IS NOT NULL
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders_n WHERE o_custkey IS NOT NULL
)
SELECT feature, CAST(COUNT(value) AS BIGINT) AS count, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS std,
       ROUND(MIN(value), 6) AS min, ROUND(QUANTILE_CONT(value, 0.25), 6) AS q25, ROUND(QUANTILE_CONT(value, 0.5), 6) AS q50,
       ROUND(QUANTILE_CONT(value, 0.75), 6) AS q75, ROUND(MAX(value), 6) AS max
FROM v GROUP BY feature
"""

SQL["null_profile"] = _with(ORDERS_N) + """
SELECT 'o_orderkey' AS feature, 'bigint' AS dtype, CAST(COUNT(o_orderkey) AS BIGINT) AS non_null,
       CAST(COUNT(*) - COUNT(o_orderkey) AS BIGINT) AS nulls FROM orders_n
UNION ALL SELECT 'o_totalprice_n', 'double', COUNT(o_totalprice_n), COUNT(*) - COUNT(o_totalprice_n) FROM orders_n
UNION ALL SELECT 'o_orderpriority_n', 'string', COUNT(o_orderpriority_n), COUNT(*) - COUNT(o_orderpriority_n) FROM orders_n
UNION ALL SELECT 'o_orderstatus', 'string', COUNT(o_orderstatus), COUNT(*) - COUNT(o_orderstatus) FROM orders_n
"""

SQL["frequent_values"] = _with(ORDERS_N) + """, v AS (
  SELECT 'o_orderpriority_n' AS feature, COALESCE(CAST(o_orderpriority_n AS VARCHAR), 'nan') AS value FROM orders_n
  UNION ALL SELECT 'o_orderstatus', COALESCE(CAST(o_orderstatus AS VARCHAR), 'nan') FROM orders_n
  UNION ALL SELECT 'o_custkey', COALESCE(CAST(o_custkey AS VARCHAR), 'nan') FROM orders_n
), c AS (
  SELECT feature, value, CAST(COUNT(*) AS BIGINT) AS count FROM v GROUP BY feature, value
)
SELECT feature, value, count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY count DESC, value) AS rank FROM c
) t WHERE rank <= 15
"""

SQL["impute_median"] = _with(ORDERS_N) + """
SELECT o_orderkey,
       ROUND(COALESCE(o_totalprice_n, (SELECT QUANTILE_CONT(o_totalprice_n, 0.5) FROM orders_n)), 6) AS o_totalprice_n
FROM orders_n
"""

SQL["impute_mode"] = _with(ORDERS_N) + """, m AS (
  SELECT o_orderpriority_n AS v FROM orders_n WHERE o_orderpriority_n IS NOT NULL
  GROUP BY o_orderpriority_n ORDER BY COUNT(*) DESC, o_orderpriority_n LIMIT 1
)
SELECT o_orderkey, COALESCE(o_orderpriority_n, (SELECT v FROM m)) AS o_orderpriority_n FROM orders_n
"""

SQL["scale_unit"] = """
SELECT o_orderkey, ROUND(o_totalprice / (SELECT CASE WHEN STDDEV_POP(o_totalprice) > 0 THEN STDDEV_POP(o_totalprice) ELSE 1 END
                                          FROM orders), 6) AS o_totalprice
FROM orders
"""

SQL["stratified_split"] = """
WITH base AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'yes' ELSE 'no' END AS label,
         md5(concat('42|', CAST(o_orderkey AS VARCHAR))) AS h
  FROM orders
), cnt AS (
  SELECT label, COUNT(*) AS c FROM base GROUP BY label
), tot AS (
  SELECT SUM(c) AS n, CAST(CEIL(SUM(c) * 0.25) AS BIGINT) AS n_test FROM cnt
), alloc AS (
  SELECT label, c, (c * (n - n_test)) // n AS fl, (c * (n - n_test)) % n AS rem, n - n_test AS n_train FROM cnt, tot
), ranked AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY rem DESC, label) AS rr,
         n_train - SUM(fl) OVER () AS short FROM alloc
), quota AS (
  SELECT label, c - (fl + CASE WHEN rr <= short THEN 1 ELSE 0 END) AS q FROM ranked
)
SELECT o_orderkey, b.label, ROW_NUMBER() OVER (PARTITION BY b.label ORDER BY h, o_orderkey) <= q.q AS is_test
FROM base b JOIN quota q ON b.label = q.label
"""

# ---------------------------------------------------------------- issues

EVIDENCE = """CONCAT('fairness_report.', {a}, '.{sec}.', {m}{g}, ' = ', CAST(ROUND(CAST({v} AS DECIMAL(20,10)), 4) AS VARCHAR))"""


def _ev(a, sec, m, v, g=None):
    return EVIDENCE.format(a=a, sec=sec, m=m, v=v, g="" if g is None else f", '.', {g}")


ISSUES = BASE + """, ex AS (
  SELECT attribute, metric,
         arg_min("group", (-value, "group")) AS hi_group, MAX(value) AS hi_value,
         arg_min("group", (value, "group")) AS lo_group, MIN(value) AS lo_value
  FROM rl GROUP BY attribute, metric
), iss AS (
  SELECT f.attribute, f.metric,
         CASE f.metric WHEN 'selection_rate' THEN 'demographic_disparity' WHEN 'true_positive_rate' THEN 'unequal_opportunity'
              WHEN 'false_positive_rate' THEN 'unequal_harm' END AS issue_type,
         CASE WHEN f.difference >= CAST(0.1 AS DOUBLE) THEN 'severe' WHEN f.difference >= CAST(0.05 AS DOUBLE) THEN 'moderate'
              WHEN f.difference >= CAST(0.025 AS DOUBLE) THEN 'mild' ELSE 'unknown' END AS severity,
         """ + _ev("f.attribute", "difference", "f.metric", "f.difference") + """ AS e0,
         """ + _ev("f.attribute", "by_group", "f.metric", "ex.hi_value", "ex.hi_group") + """ AS e1,
         """ + _ev("f.attribute", "by_group", "f.metric", "ex.lo_value", "ex.lo_group") + """ AS e2
  FROM flags f JOIN ex ON f.attribute = ex.attribute AND f.metric = ex.metric WHERE f.flag
)
"""

SQL["issues"] = ISSUES + """
SELECT attribute, metric, issue_type, severity, e0 || chr(10) || e1 || chr(10) || e2 AS evidence FROM iss
"""

SQL["issues_flat"] = ISSUES + """
SELECT attribute, metric, CAST(0 AS INTEGER) AS line_no, e0 AS evidence_line FROM iss
UNION ALL SELECT attribute, metric, CAST(1 AS INTEGER), e1 FROM iss
UNION ALL SELECT attribute, metric, CAST(2 AS INTEGER), e2 FROM iss
"""

SQL["issue_evidence"] = BASE + "SELECT attribute, metric, " + _ev("attribute", "difference", "metric", "difference") \
    + " AS evidence FROM disp"

RECORDS = """
recs AS (
  SELECT event_id AS record_id, event_id, event_type,
         CASE user_id % 5 WHEN 0 THEN 'segment' WHEN 1 THEN 'priority' WHEN 2 THEN 'status' WHEN 3 THEN 'size_group'
              ELSE 'region' END AS attribute,
         CASE event_type WHEN 'view' THEN 'selection_rate' WHEN 'click' THEN 'true_positive_rate'
              WHEN 'purchase' THEN 'false_positive_rate' WHEN 'signup' THEN 'accuracy' END AS metric
  FROM events
)"""

SQL["issue_severity"] = _with(SCORED, COUNTS, RECORDS) + """
SELECT r.record_id, r.attribute, r.metric, d.difference,
       CASE WHEN d.difference >= CAST(0.1 AS DOUBLE) THEN 'severe' WHEN d.difference >= CAST(0.05 AS DOUBLE) THEN 'moderate'
            WHEN d.difference >= CAST(0.025 AS DOUBLE) THEN 'mild' ELSE 'unknown' END AS severity
FROM recs r LEFT JOIN disp d ON r.attribute = d.attribute AND r.metric = d.metric
"""

SQL["issue_check"] = _with(RECORDS) + """, chk AS (
  SELECT record_id, CASE WHEN event_type = 'error' THEN NULL ELSE attribute END AS attribute, metric,
         CASE event_id % 5 WHEN 0 THEN 'mild' WHEN 1 THEN 'moderate' WHEN 2 THEN 'severe' WHEN 3 THEN 'unknown'
              ELSE 'extreme' END AS severity,
         CASE metric WHEN 'selection_rate' THEN 'demographic_disparity' WHEN 'true_positive_rate' THEN 'unequal_opportunity'
              WHEN 'false_positive_rate' THEN 'unequal_harm' END AS issue_type,
         CASE WHEN metric IS NOT NULL THEN 1 END AS evidence
  FROM recs
)
SELECT record_id, 'detected_issues[' || CAST(record_id AS VARCHAR) || '].attribute must be a string' AS error
FROM chk WHERE attribute IS NULL
UNION ALL SELECT record_id, 'detected_issues[' || CAST(record_id AS VARCHAR)
  || '].metric must be one of [''false_positive_rate'', ''selection_rate'', ''true_positive_rate'']'
FROM chk WHERE metric IS NULL OR metric NOT IN ('selection_rate', 'true_positive_rate', 'false_positive_rate')
UNION ALL SELECT record_id, 'detected_issues[' || CAST(record_id AS VARCHAR)
  || '].severity must be one of [''mild'', ''moderate'', ''severe'', ''unknown'']'
FROM chk WHERE severity NOT IN ('mild', 'moderate', 'severe', 'unknown')
UNION ALL SELECT record_id, 'detected_issues[' || CAST(record_id AS VARCHAR) || '].issue_type must be a string'
FROM chk WHERE issue_type IS NULL
UNION ALL SELECT record_id, 'detected_issues[' || CAST(record_id AS VARCHAR) || '].evidence must be a list'
FROM chk WHERE evidence IS NULL
"""

# ---------------------------------------------------------------- plans

RECOMMENDED = BASE + """, rules AS (
  SELECT * FROM (VALUES
    ('selection_rate', 'run_feature_distribution_comparison', true, 'selection_rate disparity is flagged for this attribute.'),
    ('selection_rate', 'run_proxy_detection', true, 'selection_rate disparity is flagged for this attribute.'),
    ('true_positive_rate', 'run_threshold_sensitivity', true, 'TPR/FPR disparities are flagged for this attribute.'),
    ('false_positive_rate', 'run_threshold_sensitivity', true, 'TPR/FPR disparities are flagged for this attribute.'),
    ('true_positive_rate', 'run_slice_scan', false, 'TPR/FPR disparities are flagged.'),
    ('false_positive_rate', 'run_slice_scan', false, 'TPR/FPR disparities are flagged.')
  ) t(metric, tool, per_attribute, reason)
), recs AS (
  SELECT r.tool, CASE WHEN r.per_attribute THEN f.attribute END AS attribute, MIN(r.reason) AS reason
  FROM flags f JOIN rules r ON f.metric = r.metric WHERE f.flag GROUP BY 1, 2
)
"""

SQL["diagnostic_plan"] = RECOMMENDED + "SELECT tool, attribute, reason FROM recs"

SQL["open_tests"] = RECOMMENDED + """, done AS (
  SELECT DISTINCT
         CASE event_type WHEN 'view' THEN 'run_slice_scan' WHEN 'click' THEN 'run_feature_distribution_comparison'
              WHEN 'purchase' THEN 'run_threshold_sensitivity' WHEN 'signup' THEN 'check_group_sample_sizes'
              WHEN 'error' THEN 'run_proxy_detection' END AS tool,
         CASE event_type WHEN 'click' THEN 'priority' WHEN 'purchase' THEN 'segment' WHEN 'error' THEN 'status' END AS attribute
  FROM events
)
SELECT tool, attribute FROM recs r
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.tool = r.tool AND (r.attribute IS NULL OR r.attribute = d.attribute))
"""

SQL["plan_check"] = """
WITH plan AS (
  SELECT CASE user_id % 6 WHEN 0 THEN 'check_group_sample_sizes' WHEN 1 THEN 'run_feature_distribution_comparison'
              WHEN 2 THEN 'run_proxy_detection' WHEN 3 THEN 'run_slice_scan' WHEN 4 THEN 'run_threshold_sensitivity'
              ELSE 'run_bias_probe' END AS tool,
         CASE event_type WHEN 'view' THEN 'segment' WHEN 'click' THEN 'priority' WHEN 'purchase' THEN 'status' END AS attribute
  FROM events
), c AS (SELECT tool, attribute, CAST(COUNT(*) AS BIGINT) AS n FROM plan GROUP BY tool, attribute)
SELECT tool, attribute, 'unknown_tool' AS problem, n FROM c
WHERE tool NOT IN ('check_group_sample_sizes', 'run_feature_distribution_comparison', 'run_proxy_detection',
                   'run_slice_scan', 'run_threshold_sensitivity')
UNION ALL SELECT tool, attribute, 'duplicate', n FROM c WHERE n > 1
"""

SQL["highlights"] = SWEEP + """, wide AS (
  SELECT attribute, threshold,
         MAX(CASE WHEN metric = 'true_positive_rate' THEN difference END) AS tpr_difference,
         MAX(CASE WHEN metric = 'false_positive_rate' THEN difference END) AS fpr_difference
  FROM sweep GROUP BY attribute, threshold
), best AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY attribute ORDER BY tpr_difference, threshold) AS rn FROM wide) t
  WHERE rn = 1
), sl AS (
  """ + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS pos, CAST({c} AS VARCHAR) AS value, y_true, y_pred FROM scored"
    for i, c in enumerate(SLICE_COLS)) + """
), c AS (
  SELECT feature, pos, value,
         SUM(CASE WHEN y_true = 'good' AND y_pred = 'good' THEN 1 ELSE 0 END) AS tp,
         SUM(CASE WHEN y_true <> 'good' AND y_pred = 'good' THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN y_true = 'good' AND y_pred <> 'good' THEN 1 ELSE 0 END) AS fn,
         SUM(CASE WHEN y_true <> 'good' AND y_pred <> 'good' THEN 1 ELSE 0 END) AS tn
  FROM sl WHERE value IS NOT NULL GROUP BY feature, pos, value
), r AS (
  SELECT feature, pos, value, CAST(tp + fp + fn + tn AS BIGINT) AS n,
         CAST(tp + fp AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) AS selection_rate,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS true_positive_rate,
         CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / CAST(fp + tn AS DOUBLE) END AS false_positive_rate,
         ROW_NUMBER() OVER (ORDER BY CAST(tp + fp AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) DESC,
                            tp + fp + fn + tn DESC, pos, value) AS rk
  FROM c WHERE tp + fp + fn + tn >= 10
)
SELECT 'run_threshold_sensitivity' AS tool, attribute, 'Best TPR-gap threshold = ' || CAST(threshold AS VARCHAR) AS detail,
       CAST(NULL AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS selection_rate,
       tpr_difference AS true_positive_rate, fpr_difference AS false_positive_rate
FROM best
UNION ALL
SELECT 'run_slice_scan', '-', feature || '=' || value, CAST(n AS DOUBLE), selection_rate, true_positive_rate,
       false_positive_rate
FROM r WHERE rk <= 3
"""

# ---------------------------------------------------------------- runs (run_id = order year)

RUN_BASE = _with(SCORED) + """, rcounts AS (
  SELECT run_id, attribute, "group",
         SUM(CASE WHEN y_true = 'good' AND y_pred = 'good' THEN 1 ELSE 0 END) AS tp,
         SUM(CASE WHEN y_true <> 'good' AND y_pred = 'good' THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN y_true = 'good' AND y_pred <> 'good' THEN 1 ELSE 0 END) AS fn,
         SUM(CASE WHEN y_true <> 'good' AND y_pred <> 'good' THEN 1 ELSE 0 END) AS tn
  FROM long WHERE "group" IS NOT NULL GROUP BY run_id, attribute, "group"
), rrates AS (
  SELECT run_id, attribute, "group",
         CAST(tp + fp AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) AS selection_rate,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS true_positive_rate,
         CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / CAST(fp + tn AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS false_positive_rate
  FROM rcounts
), rrl AS (
  SELECT run_id, attribute, "group", 'selection_rate' AS metric, selection_rate AS value FROM rrates
  UNION ALL SELECT run_id, attribute, "group", 'true_positive_rate', true_positive_rate FROM rrates
  UNION ALL SELECT run_id, attribute, "group", 'false_positive_rate', false_positive_rate FROM rrates
), rdisp AS (
  SELECT run_id, attribute, metric, MAX(value) - MIN(value) AS difference FROM rrl GROUP BY run_id, attribute, metric
), rflags AS (
  SELECT *, COALESCE(difference > CAST(0.05 AS DOUBLE), false) AS flag FROM rdisp
), rissues AS (
  SELECT run_id, attribute, metric,
         CASE WHEN difference >= CAST(0.1 AS DOUBLE) THEN 'severe' WHEN difference >= CAST(0.05 AS DOUBLE) THEN 'moderate'
              WHEN difference >= CAST(0.025 AS DOUBLE) THEN 'mild' ELSE 'unknown' END AS severity
  FROM rflags WHERE flag
), rmetrics AS (
  SELECT run_id, AVG(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS accuracy, CAST(COUNT(*) AS BIGINT) AS n_test
  FROM scored GROUP BY run_id
), rcat AS (
  SELECT m.run_id, true AS has_metrics,
         EXISTS (SELECT 1 FROM rdisp d WHERE d.run_id = m.run_id) AS has_fairness_report,
         EXISTS (SELECT 1 FROM rissues i WHERE i.run_id = m.run_id) AS has_issues
  FROM rmetrics m
)
"""

SQL["run_metrics"] = RUN_BASE + """
SELECT run_id, accuracy, CAST(NULL AS DOUBLE) AS n_train, n_test, CAST(NULL AS VARCHAR) AS model_type,
       'y_true' AS label_col, 'good' AS positive_label, ['segment','priority','status','size_group'] AS sensitive_cols, CAST([] AS VARCHAR[]) AS model_classes,
       true AS has_y_score
FROM rmetrics
"""

SQL["run_catalogue"] = RUN_BASE + "SELECT * FROM rcat"

SQL["run_summary"] = RUN_BASE + """
SELECT m.run_id, m.accuracy, m.n_test,
       CAST((SELECT COUNT(*) FROM rflags f WHERE f.run_id = m.run_id AND f.flag) AS BIGINT) AS n_flagged,
       CAST((SELECT COUNT(*) FROM rissues i WHERE i.run_id = m.run_id) AS BIGINT) AS n_issues
FROM rmetrics m WHERE m.run_id = (SELECT MAX(run_id) FROM rmetrics)
"""

SQL["evidence_table"] = RUN_BASE + """
, e AS (
  SELECT run_id, 'metrics.accuracy' AS path, accuracy AS number, true AS places FROM rmetrics
  UNION ALL SELECT run_id, 'metrics.n_test', CAST(n_test AS DOUBLE), false FROM rmetrics
  UNION ALL SELECT run_id, 'fairness_report.' || attribute || '.difference.' || metric, difference, true FROM rdisp
  UNION ALL SELECT run_id, 'fairness_report.' || attribute || '.ratio.' || metric,
                   CASE WHEN MAX(value) <> 0 THEN MIN(value) / MAX(value) END, true
            FROM rrl GROUP BY run_id, attribute, metric
  UNION ALL SELECT run_id, 'fairness_report.' || attribute || '.by_group.' || metric || '.' || "group", value, true FROM rrl
  UNION ALL SELECT run_id, 'group_sizes.' || attribute || '.' || COALESCE("group", 'nan'), CAST(COUNT(*) AS DOUBLE), false
            FROM long GROUP BY run_id, attribute, "group"
)
SELECT run_id, path, CASE WHEN places THEN CAST(ROUND(CAST(number AS DECIMAL(20,10)), 4) AS VARCHAR)
                          ELSE CAST(CAST(number AS BIGINT) AS VARCHAR) END AS value, number FROM e
UNION ALL SELECT run_id, 'missing', 'issues', NULL FROM rcat WHERE NOT has_issues
UNION ALL SELECT run_id, 'missing', 'fairness_report', NULL FROM rcat WHERE NOT has_fairness_report
"""

SQL["score_feature_join"] = """
WITH s AS (
  SELECT o_orderkey AS row_index, CASE WHEN o_orderstatus = 'F' THEN 'good' ELSE 'bad' END AS y_true,
         CASE WHEN CAST((o_orderkey * 37 + o_custkey * 11) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) >= CAST(0.5 AS DOUBLE)
              THEN 'good' ELSE 'bad' END AS y_pred
  FROM orders
), f AS (
  SELECT l_orderkey AS row_index, CAST(COUNT(*) AS BIGINT) AS n_lines, SUM(l_quantity) AS total_qty,
         AVG(l_discount) AS avg_discount
  FROM lineitem GROUP BY l_orderkey
)
SELECT s.row_index, y_true, y_pred, n_lines, total_qty, ROUND(avg_discount, 6) AS avg_discount
FROM s JOIN f ON s.row_index = f.row_index
"""

SQL["proxy_unsupported"] = _with(SCORED) + """
SELECT 'segment' AS attribute, string_agg(v, ',' ORDER BY v) AS classes, COUNT(*) AS n_classes, 'unsupported' AS status
FROM (SELECT DISTINCT COALESCE(segment, 'nan') AS v FROM scored)
"""

SQL["split_counts"] = """
WITH t AS (SELECT COUNT(*) AS n, CAST(CEIL(0.25 * COUNT(*)) AS BIGINT) AS k FROM orders)
SELECT 'test' AS split, k AS n FROM t UNION ALL SELECT 'train', n - k FROM t
"""

SQL["scored_store"] = _with(SCORED) + """
SELECT run_id, COUNT(*) AS n, SUM(CASE WHEN y_pred = 'good' THEN 1 ELSE 0 END)::BIGINT AS selected,
       MAX(y_score) AS max_score, SUM(l_orderkey)::BIGINT AS keys
FROM scored GROUP BY run_id
"""

SQL["read_csv"] = SQL["read_delimited"] = """
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS customer,
       CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS status, o_orderkey % 2 = 0 AS even,
       o_orderkey || 'd' AS code, o_orderkey::DOUBLE / 4 AS quarter
FROM orders
"""

# ---------------------------------------------------------------- all runs at once

SQL["column_cardinality_by_run"] = _with(SCORED) + ", card AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT run_id, '{c}' AS feature, {i} AS position, COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
    f" AS n_distinct FROM scored GROUP BY run_id" for i, c in enumerate(FEATURES)
) + """
)
SELECT run_id, feature, CAST(position AS INTEGER) AS position, CAST(n_distinct AS BIGINT) AS n_distinct
FROM card WHERE n_distinct <= 8
"""

SQL["column_cardinality_stored"] = _with(SCORED) + ", card AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS position, COUNT(*) AS n, COUNT(*) - COUNT({c}) AS nulls, "
    f"COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct FROM scored"
    for i, c in enumerate(FEATURES)
) + """
)
SELECT feature, CAST(position AS INTEGER) AS position, CAST(n AS BIGINT) AS n, CAST(nulls AS BIGINT) AS nulls,
       CAST(n_distinct AS BIGINT) AS n_distinct
FROM card WHERE n_distinct <= 8
"""

SQL["slice_scan_by_run"] = _with(SCORED) + ", sl AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT run_id, '{c}' AS feature, {i} AS pos, CAST({c} AS VARCHAR) AS value, y_true, y_pred FROM scored"
    for i, c in enumerate(FEATURES)
) + """
), c AS (
  SELECT run_id, feature, pos, value,
         SUM(CASE WHEN y_true = 'good' AND y_pred = 'good' THEN 1 ELSE 0 END) AS tp,
         SUM(CASE WHEN y_true <> 'good' AND y_pred = 'good' THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN y_true = 'good' AND y_pred <> 'good' THEN 1 ELSE 0 END) AS fn,
         SUM(CASE WHEN y_true <> 'good' AND y_pred <> 'good' THEN 1 ELSE 0 END) AS tn,
         COUNT(*) OVER (PARTITION BY run_id, feature) AS n_distinct
  FROM sl GROUP BY run_id, feature, pos, value
), low AS (
  SELECT *, DENSE_RANK() OVER (PARTITION BY run_id ORDER BY pos) AS col_rank FROM c WHERE n_distinct <= 8
), r AS (
  SELECT run_id, feature, pos, value, CAST(tp + fp + fn + tn AS BIGINT) AS n,
         CAST(tp + fp AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) AS selection_rate,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS true_positive_rate,
         CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / CAST(fp + tn AS DOUBLE) END AS false_positive_rate
  FROM low WHERE col_rank <= 5 AND value IS NOT NULL AND tp + fp + fn + tn >= 10
), ranked AS (
  SELECT CAST(ROW_NUMBER() OVER (PARTITION BY run_id
         ORDER BY selection_rate DESC, n DESC, pos, TRY_CAST(value AS DOUBLE) NULLS LAST, value) AS INTEGER) AS rank, * FROM r
)
SELECT run_id, rank, feature, value, n, selection_rate, true_positive_rate, false_positive_rate
FROM ranked WHERE rank <= 20
"""

TWO_BY_RUN = """, gs AS (
  SELECT run_id, COALESCE(segment, 'nan') AS g, COUNT(*) AS n FROM scored GROUP BY 1, 2
), top2 AS (
  SELECT run_id, g, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY n DESC, g) AS r FROM gs
), names AS (
  SELECT run_id, MAX(CASE WHEN r = 1 THEN g END) AS group_a, MAX(CASE WHEN r = 2 THEN g END) AS group_b
  FROM top2 GROUP BY run_id
), two AS (
  SELECT s.*, t.r, t.g AS grp FROM scored s JOIN top2 t ON s.run_id = t.run_id AND COALESCE(s.segment, 'nan') = t.g
  WHERE t.r <= 2
)"""

SQL["numeric_shift_by_run"] = _with(SCORED) + TWO_BY_RUN + ", m AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT run_id, '{c}' AS feature, {i} AS position, AVG(CASE WHEN r = 1 THEN CAST({c} AS DOUBLE) END) AS mean_a, "
    f"AVG(CASE WHEN r = 2 THEN CAST({c} AS DOUBLE) END) AS mean_b FROM two GROUP BY run_id"
    for i, c in enumerate(NUMERIC)
) + """
), ranked AS (
  SELECT *, ABS(mean_a - mean_b) AS abs_mean_diff, CAST(ROW_NUMBER() OVER (
    PARTITION BY run_id ORDER BY ABS(mean_a - mean_b) DESC NULLS FIRST, position) AS INTEGER) AS rank FROM m
)
SELECT run_id, rank, feature, group_a, group_b, ROUND(mean_a, 6) AS mean_a, ROUND(mean_b, 6) AS mean_b,
       ROUND(abs_mean_diff, 6) AS abs_mean_diff
FROM ranked JOIN names USING (run_id) WHERE rank <= 10
"""

SQL["categorical_shift_by_run"] = _with(SCORED) + TWO_BY_RUN + ", tl AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT run_id, r, '{c}' AS feature, {i} AS position, COALESCE(CAST({c} AS VARCHAR), 'nan') AS value FROM two"
    for i, c in enumerate(CATEGORICAL)
) + """
), cnt AS (
  SELECT run_id, r, feature, position, value, COUNT(*) AS cnt FROM tl GROUP BY ALL
), sh AS (
  SELECT *, CAST(cnt AS DOUBLE) / CAST(SUM(cnt) OVER (PARTITION BY run_id, r, feature) AS DOUBLE) AS share,
         ROW_NUMBER() OVER (PARTITION BY run_id, r, feature ORDER BY cnt DESC, value) AS place
  FROM cnt
), pv AS (
  SELECT run_id, feature, position, value, COALESCE(MAX(CASE WHEN r = 1 THEN share END), 0) AS pa,
         COALESCE(MAX(CASE WHEN r = 2 THEN share END), 0) AS pb
  FROM sh WHERE place <= 5 GROUP BY run_id, feature, position, value
), tvd AS (
  SELECT run_id, feature, position, 0.5 * SUM(ABS(pa - pb)) AS tvd FROM pv GROUP BY run_id, feature, position
), ranked AS (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY tvd DESC, position) AS INTEGER) AS rank FROM tvd
)
SELECT run_id, rank, feature, group_a, group_b, ROUND(CAST(tvd AS DOUBLE), 9) AS total_variation_distance
FROM ranked JOIN names USING (run_id) WHERE rank <= 10 AND group_b IS NOT NULL
"""

# ---------------------------------------------------------------- documents, commits, row numbers

_AT = "CAST(CAST({0} AS BIGINT) AS VARCHAR)"
_FOUR = "CAST(ROUND(CAST({0} AS DECIMAL(20,10)), 4) AS VARCHAR)"


def _doc_cell(path, value, number, source):
    return f"SELECT run_id, {path} AS path, {value} AS value, {number} AS number FROM {source}"


_NONE = "CAST(NULL AS DOUBLE)"
_ALL_RUNS = "rmetrics"
_CONSTANTS = {
    "metrics.label_col": "y_true", "metrics.positive_label": "good", "metrics.has_y_score": "true",
    "audit_config.label_col": "y_true", "audit_config.positive_label": "good",
    "audit_config.model.type": "logistic_regression",
    **{f"{p}.sensitive_cols.{i}": a for p in ("metrics", "audit_config")
       for i, a in enumerate(("segment", "priority", "status", "size_group"))}}
_NUMBERS = {"audit_config.min_group_size": ("30", 30.0), "audit_config.fairness_threshold": ("0.0500", 0.05),
            "audit_config.test_size": ("0.2500", 0.25), "audit_config.random_state": ("42", 42.0),
            "audit_config.model.max_iter": ("2000", 2000.0)}

SQL["run_documents"] = RUN_BASE + RECOMMENDED[RECOMMENDED.index(", rules AS ("):RECOMMENDED.index(", recs AS (")] + """
, rplan AS (
  SELECT f.run_id, r.tool, CASE WHEN r.per_attribute THEN f.attribute END AS attribute, MIN(r.reason) AS reason
  FROM rflags f JOIN rules r ON f.metric = r.metric WHERE f.flag GROUP BY 1, 2, 3
), pl AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY tool, attribute) - 1 AS i FROM rplan
), rex AS (
  SELECT run_id, attribute, metric, arg_min("group", (-value, "group")) AS hi_group, MAX(value) AS hi_value,
         arg_min("group", (value, "group")) AS lo_group, MIN(value) AS lo_value
  FROM rrl GROUP BY run_id, attribute, metric
), iss AS (
  SELECT r.run_id, r.attribute, r.metric, r.severity,
         CASE r.metric WHEN 'selection_rate' THEN 'demographic_disparity' WHEN 'true_positive_rate' THEN 'unequal_opportunity'
              WHEN 'false_positive_rate' THEN 'unequal_harm' END AS issue_type,
         """ + _ev("r.attribute", "difference", "r.metric", "d.difference") + """ AS e0,
         """ + _ev("r.attribute", "by_group", "r.metric", "rex.hi_value", "rex.hi_group") + """ AS e1,
         """ + _ev("r.attribute", "by_group", "r.metric", "rex.lo_value", "rex.lo_group") + """ AS e2,
         ROW_NUMBER() OVER (PARTITION BY r.run_id ORDER BY r.attribute, r.metric) - 1 AS i
  FROM rissues r JOIN rdisp d USING (run_id, attribute, metric) JOIN rex USING (run_id, attribute, metric)
), doc AS (
""" + "\nUNION ALL ".join(
    [_doc_cell("'metrics.accuracy'", _FOUR.format("accuracy"), "accuracy", _ALL_RUNS),
     _doc_cell("'metrics.n_test'", _AT.format("n_test"), "CAST(n_test AS DOUBLE)", _ALL_RUNS),
     _doc_cell("'fairness_report.' || attribute || '.by_group.' || metric || '.' || \"group\"", _FOUR.format("value"),
               "value", "rrl"),
     _doc_cell("'fairness_report.' || attribute || '.difference.' || metric", _FOUR.format("difference"), "difference",
               "rdisp"),
     _doc_cell("'fairness_report.' || attribute || '.ratio.' || metric", _FOUR.format("lo_value / hi_value"),
               "lo_value / hi_value", "rex WHERE hi_value <> 0"),
     _doc_cell("'fairness_report.' || attribute || '.flags.' || metric", "CASE WHEN flag THEN 'true' ELSE 'false' END",
               _NONE, "rflags"),
     _doc_cell("'group_sizes.' || attribute || '.' || g", _AT.format("n"), "CAST(n AS DOUBLE)",
               "(SELECT run_id, attribute, COALESCE(\"group\", 'nan') AS g, COUNT(*) AS n FROM long GROUP BY 1, 2, 3) z"),
     *[_doc_cell(f"'plan.' || {_AT.format('i')} || '.{c}'", c, _NONE, f"pl WHERE {c} IS NOT NULL")
       for c in ("tool", "attribute", "reason")],
     *[_doc_cell(f"'issues.' || {_AT.format('i')} || '.{c}'", c, _NONE, "iss")
       for c in ("attribute", "metric", "issue_type", "severity")],
     *[_doc_cell(f"'issues.' || {_AT.format('i')} || '.evidence.{k}'", f"e{k}", _NONE, "iss") for k in range(3)],
     *[_doc_cell(f"'{p}'", f"'{v}'", _NONE, _ALL_RUNS) for p, v in _CONSTANTS.items()],
     *[_doc_cell(f"'{p}'", f"'{t}'", f"CAST({v} AS DOUBLE)", _ALL_RUNS) for p, (t, v) in _NUMBERS.items()]]) + """
)
SELECT run_id, path, value, number FROM doc
"""

SQL["stored_runs"] = _with(SCORED) + """
SELECT run_id, true AS has_scored, false AS has_issues, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS keys
FROM scored WHERE run_id <> (SELECT MAX(run_id) FROM scored) GROUP BY run_id
"""

SQL["row_numbers"] = """
WITH base AS (
  SELECT o_orderkey, o_orderstatus, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders
), hashed AS (
  SELECT *, md5(concat('42|', CAST(row_index AS VARCHAR))) AS h FROM base
), cnt AS (
  SELECT o_orderstatus AS label, COUNT(*) AS c FROM base GROUP BY 1
), tot AS (
  SELECT SUM(c) AS n, CAST(CEIL(SUM(c) * 0.25) AS BIGINT) AS n_test FROM cnt
), alloc AS (
  SELECT label, c, (c * (n - n_test)) // n AS fl, (c * (n - n_test)) % n AS rem, n - n_test AS n_train FROM cnt, tot
), ranked AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY rem DESC, label) AS rr, n_train - SUM(fl) OVER () AS short FROM alloc
), quota AS (
  SELECT label, c - (fl + CASE WHEN rr <= short THEN 1 ELSE 0 END) AS q FROM ranked
)
SELECT o_orderkey, o_orderstatus, CAST(row_index AS BIGINT) AS row_index,
       ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY h, row_index) <= q AS is_test
FROM hashed JOIN quota ON o_orderstatus = label
"""

# ---------------------------------------------------------------- sources and sinks

SQL["prepared_dataset"] = """
WITH b AS (
  SELECT o_orderkey, o_totalprice, CASE CAST(o_orderstatus AS VARCHAR) WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' END AS status,
         CASE WHEN o_totalprice > 0 AND o_totalprice <= 50000 THEN 'low'
              WHEN o_totalprice > 50000 AND o_totalprice <= 150000 THEN 'mid'
              WHEN o_totalprice > 150000 AND o_totalprice <= 300000 THEN 'high'
              WHEN o_totalprice > 300000 AND o_totalprice <= 500000 THEN 'top' END AS band
  FROM orders
)
SELECT status, CASE WHEN band IN ('low', 'mid') THEN 'small' WHEN band IN ('high', 'top') THEN 'big' END AS tier,
       o_orderkey AS key, o_totalprice AS price, band
FROM b
"""

SQL["pair_shift"] = _with(SCORED) + ", m AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS position, AVG(CASE WHEN segment = 'MACHINERY' THEN CAST({c} AS DOUBLE) END) AS mean_a, "
    f"AVG(CASE WHEN segment = 'BUILDING' THEN CAST({c} AS DOUBLE) END) AS mean_b FROM scored" for i, c in enumerate(NUMERIC)
) + """
)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY ABS(mean_a - mean_b) DESC NULLS FIRST, position) AS INTEGER) AS rank, feature,
       'MACHINERY' AS group_a, 'BUILDING' AS group_b, ROUND(mean_a, 6) AS mean_a, ROUND(mean_b, 6) AS mean_b,
       ROUND(ABS(mean_a - mean_b), 6) AS abs_mean_diff
FROM m
"""

SQL["feature_store"] = _with(SCORED) + """
SELECT run_id, c_mktsegment, CAST(COUNT(*) AS BIGINT) AS n, SUM(l_quantity) AS quantity, MAX(o_totalprice) AS top_price
FROM scored WHERE run_id = (SELECT MAX(run_id) FROM scored) GROUP BY run_id, c_mktsegment
"""

SQL["rates_csv"] = BASE + "SELECT * FROM rates"
