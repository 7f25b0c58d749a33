"""Scalar column expressions (JVM-side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

from typing import Any, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from equiaudit import constants as C


#: What counts as a number in text: no suffix letters, which a cast alone would take.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?|[nN]a[nN])\s*$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c: str | Column) -> Column:
    """Values compare as strings (maps and positive labels)."""
    return _col(c).cast("string")


def value_map(c: str | Column, mapping: Mapping[Any, Any]) -> Column:
    """B1/B2: literal value map on the string form of ``c``; unmapped or null -> null.

    A literal ``map`` keeps the lookup inside generated code.  Very large maps
    belong in a broadcast join instead (see :func:`equiaudit.operators.derive.map_by_join`).
    """
    if not mapping:
        return F.lit(None).cast("string")
    # keys compare as text, so 1 and "1" are one key; the last one wins
    pairs = []
    for k, v in {str(k): v for k, v in mapping.items()}.items():
        pairs += [F.lit(k), F.lit(None if v is None else str(v))]
    return F.try_element_at(F.create_map(*pairs), as_text(c))


def right_closed_bins(c: str | Column, bins: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins ``(lo, hi]``; the lowest edge itself, values outside, null and NaN -> null."""
    if len(labels) != len(bins) - 1:
        raise ValueError("bins need exactly one more edge than labels")
    x = _col(c).cast("double")
    out = None
    for lo, hi, lab in zip(bins[:-1], bins[1:], labels):
        cond = (x > F.lit(float(lo))) & (x <= F.lit(float(hi)))
        out = F.when(cond, F.lit(str(lab))) if out is None else out.when(cond, F.lit(str(lab)))
    return out


def positive_flag(c: str | Column, positive_label: Any) -> Column:
    """1 where the value equals the positive label (as text), else 0; null -> 0."""
    return F.coalesce(as_text(c) == F.lit(str(positive_label)), F.lit(False)).cast("int")


def coerce_numeric(c: str | Column) -> Column:
    """Numeric coercion, unparsable -> null, NaN -> null.

    The pattern is tested for text only: ``typeof`` is a constant, so the test folds away for numeric columns."""
    x = _col(c).try_cast("double")
    no_number = (F.typeof(_col(c)) == "string") & ~as_text(c).rlike(NUMBER)
    return F.when(F.isnan(x) | no_number, F.lit(None).cast("double")).otherwise(x)


def text_or_null_token(c: str | Column, token: str = C.NULL_GROUP_LABEL) -> Column:
    """String form with nulls shown as ``token``."""
    return F.coalesce(as_text(c), F.lit(token))


def na_tokens(c: str | Column, tokens: Sequence[str]) -> Column:
    """A5: values equal to one of ``tokens`` become null."""
    x = _col(c)
    return F.when(as_text(x).isin(list(tokens)), F.lit(None)).otherwise(x)


def predicted_at(score: str | Column, cut: float) -> Column:
    """``score >= cut`` as 0/1; NaN and null count as 0 (Spark orders NaN above all)."""
    s = coerce_numeric(score)
    return F.coalesce(s >= F.lit(float(cut)), F.lit(False)).cast("int")


def cut_bucket(score: str | Column, cuts: Sequence[float]) -> Column:
    """Number of cuts ``<= score`` (0..len(cuts)); NaN/null -> 0."""
    s = coerce_numeric(score)
    total = F.lit(0)
    for t in cuts:
        total = total + F.coalesce(s >= F.lit(float(t)), F.lit(False)).cast("int")
    return total


def severity(difference: str | Column, threshold: float) -> Column:
    """H9: severity band of a difference; null/NaN and values below the lowest band -> unknown."""
    d = coerce_numeric(difference)
    out = None
    for name, mult in C.SEVERITY_BANDS:
        cond = d >= F.lit(float(mult) * float(threshold))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.coalesce(out, F.lit("unknown"))


def risk_band(auc: str | Column) -> Column:
    """H6: proxy risk band; null AUC -> null."""
    a = coerce_numeric(auc)
    out = None
    for name, lo in C.RISK_BANDS:
        cond = a >= F.lit(float(lo))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.when(a.isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(F.lit(C.RISK_DEFAULT)))


def issue_type(metric: str | Column) -> Column:
    """Issue type of a metric; other metrics -> null."""
    return value_map(metric, C.ISSUE_TYPES)


def fixed4(x: str | Column) -> Column:
    """Decimal text of a double with four places, rounded half-up on its decimal form."""
    return F.round(_col(x).cast("decimal(20,10)"), 4).cast("string")


def evidence_path(attribute: str | Column, section: str, metric: str | Column, value: str | Column,
                  group: str | Column | None = None) -> Column:
    """``fairness_report.<attr>.<section>.<metric>[.<group>] = <value>``."""
    parts = [F.lit("fairness_report."), _col(attribute), F.lit(f".{section}."), _col(metric)]
    if group is not None:
        parts += [F.lit("."), _col(group)]
    parts += [F.lit(" = "), fixed4(value)]
    return F.concat(*parts)
