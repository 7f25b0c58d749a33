"""equiaudit: group-fairness auditing of binary classifiers as Spark DataFrame plans.

The library turns a table of scored rows (``y_true``, ``y_pred``, optional
``y_score``, sensitive attributes, features) into small audit tables:
group sizes, confusion counts, per-group rates, disparities, flags,
severities, diagnostics and a rule-based diagnostic plan.  All heavy work is
expressed with the DataFrame API so Catalyst prunes columns, pushes filters
into the Parquet scan and pre-aggregates before every shuffle.
"""

from equiaudit.spec import AuditSpec

__all__ = ["AuditSpec"]
