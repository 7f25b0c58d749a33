from equiaudit.functions.expressions import (  # noqa: F401
    NUMBER,
    as_text,
    coerce_numeric,
    cut_bucket,
    evidence_path,
    fixed4,
    issue_type,
    na_tokens,
    positive_flag,
    predicted_at,
    right_closed_bins,
    risk_band,
    severity,
    text_or_null_token,
    value_map,
)
