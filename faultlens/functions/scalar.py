"""Column functions: risk bands, probabilities, capacity, rounding, text and time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.schema import instant, micros

# Risk names and cut-offs.
NORMAL, ALERT, CRITICAL = "NORMAL", "ALERTA", "CRÍTICO"
RISK_BANDS = ((0.30, NORMAL), (0.65, ALERT))
SCRIPT_BANDS = ((0.30, "LOW"), (0.70, "MÉDIO"))
SEVERITY_RANK = {NORMAL: 0, ALERT: 1, CRITICAL: 2}
ALERT_THRESHOLD = 0.70
TOAST_THRESHOLD = 0.65
DEFAULT_THRESHOLD = 0.5
# Upper operating limit of each charted sensor.
CEILINGS = {
    "TP2": 12.0,
    "TP3": 12.0,
    "H1": 12.0,
    "Motor_current": 10.0,
    "Oil_temperature": 80.0,
    "Reservoirs": 12.0,
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def risk_level(
    p: str | Column, bands: Sequence[tuple[float, str]] = RISK_BANDS, above: str = CRITICAL
) -> Column:
    """The name of the first band whose upper bound lies above `p`."""
    p = _col(p)
    out = F.when(p.isNull(), None)
    for upper, name in bands:
        out = out.when(p < upper, name)
    return out.otherwise(above)


def severity_rank(severity: str | Column) -> Column:
    severity = _col(severity)
    out = F.when(F.lit(False), F.lit(0))
    for name, rank in SEVERITY_RANK.items():
        out = out.when(severity == name, rank)
    return out


def toast_severity(p: str | Column, threshold: float = TOAST_THRESHOLD) -> Column:
    return F.when(_col(p) >= threshold, "critical").otherwise("warning")


def is_finite(x: str | Column) -> Column:
    x = _col(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def clamp(x: str | Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clamp a number; NULL and NaN give NULL.

    Spark orders NaN above every number and `least` skips NULL, so both are tested first.
    """
    x = _col(x)
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sanitize_probability(p: str | Column) -> Column:
    """NULL unless a finite number; then clamped to [0, 1]."""
    return F.when(is_finite(p), clamp(p))


def sanitize_text_probability(text: str | Column) -> Column:
    """Like `sanitize_probability` for a JSON value: quoted numbers are not numbers."""
    text = _col(text)
    return F.when(~text.startswith('"'), sanitize_probability(text.try_cast("double")))


def capacity_percent(value: str | Column, ceiling: float) -> Column:
    return F.round(clamp(_col(value) / F.lit(ceiling) * 100, 0.0, 100.0), 1)


def blend(healthy: str | Column, faulty: str | Column, drift: Column) -> Column:
    return _col(healthy) + drift * (_col(faulty) - _col(healthy))


def decide(p: str | Column, threshold: float | Column = DEFAULT_THRESHOLD) -> Column:
    return (_col(p) >= threshold).cast("int")


def resolve_threshold(raw: str | Column, default: float = DEFAULT_THRESHOLD) -> Column:
    """A textual threshold if it parses and lies inside (0, 1), else the default."""
    t = _col(raw).try_cast("double")
    return F.coalesce(F.when((t > 0) & (t < 1), t), F.lit(default))


def sigmoid(x: Column) -> Column:
    """Logistic function, written so that exp never overflows."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def anomaly_score(error: str | Column, threshold: float | Column) -> Column:
    """Sigmoid of the distance of a reconstruction error from its threshold."""
    if not isinstance(threshold, Column):
        if threshold <= 0:
            raise ValueError("the error threshold must be positive")
        threshold = F.lit(float(threshold))
    scale = F.greatest(threshold / 3, F.lit(1e-10))
    return sigmoid((_col(error) - threshold) / scale)


def softmax2(logit0: str | Column, logit1: str | Column) -> Column:
    """Probability of class 1 from two logits, shifted by their maximum."""
    a, b = _col(logit0), _col(logit1)
    top = F.greatest(a, b)
    return F.exp(b - top) / (F.exp(a - top) + F.exp(b - top))


def alert_id(asset: str | Column, ts: str | Column) -> Column:
    """A message id that a replayed batch reproduces."""
    return F.md5(F.concat_ws("|", _col(asset).cast("string"), micros(ts).cast("string")))


def chart_point(columns: Mapping[str, int]) -> dict[str, Column]:
    return {name: F.round(name, digits) for name, digits in columns.items()}


def day_label(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "dd/MM")


def time_label(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "HH:mm:ss")


def iso_text(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_millis(ts: str | Column) -> Column:
    return F.unix_millis(instant(ts))


def one_json_object(text: str | Column) -> Column:
    """`text` if it is exactly one JSON object with nothing behind it, else NULL.

    Inside brackets anything after the object is a syntax error or a second element.
    """
    text = F.col(text) if isinstance(text, str) else text
    listed = F.concat(F.lit("["), text, F.lit("]"))
    return F.when(F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 1) & F.json_object_keys(text).isNotNull(), text)
