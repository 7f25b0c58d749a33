"""Audit configuration (driver-side) and the cheap validations that go with it."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiaudit import constants as C


@dataclass(frozen=True)
class DerivedColumn:
    """A derived column: ``kind`` is ``"map"`` (value map) or ``"bin"`` (right-closed bins)."""

    name: str
    kind: str
    source: str
    mapping: Mapping[str, Any] | None = None
    bins: Sequence[float] | None = None
    labels: Sequence[str] | None = None


@dataclass(frozen=True)
class DatasetSpec:
    path: str | None = None
    format: str | None = None
    sep: str | None = None
    header: bool | None = None
    columns: Sequence[str] | None = None
    schema_path: str | None = None
    na_values: Sequence[str] | None = None
    encoding: str = "utf-8"
    source: str | None = None


@dataclass(frozen=True)
class AuditSpec:
    label_col: str = "y_true"
    positive_label: str = "good"
    sensitive_cols: Sequence[str] = ()
    label_map: Mapping[str, Any] | None = None
    derived_columns: Sequence[DerivedColumn] = ()
    min_group_size: int = C.DEFAULT_MIN_GROUP_SIZE
    fairness_threshold: float = C.DEFAULT_FAIRNESS_THRESHOLD
    test_size: float = C.DEFAULT_TEST_SIZE
    random_state: int = C.DEFAULT_RANDOM_STATE
    model_type: str = "logistic_regression"
    max_iter: int = 2000
    #: Keyword options of diagnostics by tool, such as {"run_slice_scan": {"top": None, "min_support": 30}}; None lifts
    #: a limit.
    diagnostic_options: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    dataset: DatasetSpec = field(default_factory=DatasetSpec)

    @staticmethod
    def from_dict(cfg: Mapping[str, Any]) -> "AuditSpec":
        """Build a spec from a parsed YAML/JSON config with the audited layout."""
        derived = []
        for name, d in (cfg.get("derived_columns") or {}).items():
            derived.append(
                DerivedColumn(
                    name=name,
                    kind=d.get("type"),
                    source=d.get("source"),
                    mapping=d.get("mapping"),
                    bins=d.get("bins"),
                    labels=d.get("labels"),
                )
            )
        ds = cfg.get("dataset") or {}
        model = cfg.get("model") or {}
        return AuditSpec(
            label_col=cfg.get("label_col", "y_true"),
            positive_label=str(cfg.get("positive_label")),
            sensitive_cols=tuple(cfg.get("sensitive_cols") or ()),
            label_map=cfg.get("label_map"),
            derived_columns=tuple(derived),
            min_group_size=int(cfg.get("min_group_size", C.DEFAULT_MIN_GROUP_SIZE)),
            fairness_threshold=float(cfg.get("fairness_threshold", C.DEFAULT_FAIRNESS_THRESHOLD)),
            test_size=float(cfg.get("test_size", C.DEFAULT_TEST_SIZE)),
            random_state=int(cfg.get("random_state", C.DEFAULT_RANDOM_STATE)),
            model_type=model.get("type", "logistic_regression"),
            max_iter=int(model.get("max_iter", 2000)),
            diagnostic_options=cfg.get("diagnostics") or {},
            dataset=DatasetSpec(
                path=ds.get("path"),
                format=ds.get("format"),
                sep=ds.get("sep"),
                header=ds.get("header"),
                columns=ds.get("columns"),
                schema_path=ds.get("schema_path"),
                na_values=ds.get("na_values"),
                encoding=ds.get("encoding", "utf-8"),
                source=ds.get("source"),
            ),
        )


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "input") -> None:
    """Schema-only check, runs no job."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def label_values(df: DataFrame, label_col: str) -> DataFrame:
    """The distinct non-null label values."""
    return df.select(F.col(label_col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()


class LabelError(ValueError):
    """A label that does not have two values; ``values`` is the table of all it has."""

    def __init__(self, text: str, values: DataFrame):
        super().__init__(text)
        self.values = values


def validate_binary_label(df: DataFrame, label_col: str, shown: int = 100) -> list[str]:
    """Raise unless the label has exactly two non-null values; returns them sorted.

    The error's text shows ``shown`` of the values it found, its ``values`` all of them as a table."""
    found = label_values(df, label_col)
    vals = sorted(r["value"] for r in found.limit(3).collect())
    if len(vals) != 2:
        n, vals = found.count(), [r["value"] for r in found.orderBy("value").limit(shown).collect()]
        raise LabelError(f"label {label_col} must have two values; it has {n}: {vals}" + " and more" * (n > len(vals)), found)
    return vals


def infer_format(path: str, fmt: str | None) -> str:
    """A4: explicit format wins, else the file extension decides."""
    if fmt:
        return fmt.lower()
    ext = os.path.splitext(path)[1].lower()
    if ext == ".tsv":
        return "tsv"
    if ext in (".data", ".txt"):
        return "delimited"
    if ext == ".parquet":
        return "parquet"
    return "csv"
