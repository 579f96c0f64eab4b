"""Scalar functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnflow.config import RiskConfig


def bind(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once. Without it, an expression that names a costly column several times repeats that
    column's whole expression wherever filters are pushed down."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def ip_to_int(ip: Column) -> Column:
    """Number of a dotted IPv4 address of exactly four parts from 0 to 255; -1 for anything else."""
    parts = F.split(F.coalesce(ip, F.lit("")), r"\.")
    ok = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$") & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    n = F.aggregate(F.transform(parts, lambda p: F.coalesce(p.try_cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    return F.when(ok, n).otherwise(F.lit(-1).cast("long"))


def int_to_ip(n: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(n, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)])


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval, clipped to [0, 1]; zeros without trials."""
    p = hits / n
    denominator = 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / denominator, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denominator
    clip = lambda c: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(0.0)
    return clip(centre - half), clip(centre + half)


def window_of_step(step: Column, first: str = "2019-01-07", days: int = 14) -> tuple[Column, Column]:
    """Start and end (exclusive) date of a coarse time step, counted from 1."""
    start = F.date_add(F.lit(first).cast("date"), ((step - 1) * days).cast("int"))
    return start, F.date_add(start, days)


def step_of(ts: Column, first: str = "2019-01-07", days: int = 14) -> Column:
    return (F.floor(F.datediff(ts, F.lit(first).cast("date")) / days) + 1).cast("int")


def in_window(ts: Column, start: Column, end: Column, tolerance_s: int = 0) -> Column:
    """Half-open, widened by the tolerance on either side."""
    return (ts >= start - tolerance_s) & (ts < end + tolerance_s)


def proximity(ts: Column, start: Column, end: Column, half_life_s: float = 86400.0) -> Column:
    """1 inside [start, end], then halved with every half-life of distance."""
    away = F.greatest(start - ts, ts - end, F.lit(0))
    return F.exp(F.lit(-math.log(2)) * away / half_life_s)


def burst_consistency(span_s: Column, limit_s: float = 60.0) -> Column:
    return F.when(span_s <= limit_s, 1.0).otherwise(F.greatest(F.lit(0.05), 1 / F.log2(span_s / limit_s + 1)))


def hop_consistency(mean_ms: Column, limit_ms: float = 5000.0) -> Column:
    return F.when(mean_ms <= limit_ms, 1.0).otherwise(F.greatest(F.lit(0.1), 1 / (1 + (mean_ms - limit_ms) / 1000)))


def topology_consistency(hops: Column, same: Column) -> Column:
    """By hops between two nodes: 1, .75, .40, beyond .15; .8 where the topology is unknown; .5 for a node and itself."""
    return F.when(same, 0.5).when(hops.isNull(), 0.8).when(hops <= 1, 1.0).when(hops == 2, 0.75).when(hops == 3, 0.40).otherwise(0.15)


def composite_confidence(time: Column, propagation: Column, topology: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.40 * time + 0.35 * propagation + 0.25 * topology))


def noisy_or(*parts: Column) -> Column:
    out = F.lit(1.0)
    for p in parts:
        out = out * (1 - p)
    return 1 - out


def tier(score: Column, c: RiskConfig = RiskConfig()) -> Column:
    out = F.lit(c.lowest)
    for name, least in reversed(c.tiers):
        out = F.when(score >= least, name).otherwise(out)
    return out


def tier_rank(name: Column, c: RiskConfig = RiskConfig()) -> Column:
    """0 for the lowest tier, growing with severity."""
    out = F.lit(0)
    for i, (n, _) in enumerate(reversed(c.tiers)):
        out = F.when(name == n, i + 1).otherwise(out)
    return out


def seed_boost(score: Column, risk: Column, weight: float = RiskConfig().seed_weight) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score + (100 - score) * weight * risk))


def severity(anomaly: Column) -> Column:
    return F.when(anomaly >= 0.8, "critical").when(anomaly >= 0.6, "high").when(anomaly >= 0.4, "medium").otherwise("low")


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def humanize(seconds: Column) -> Column:
    unit = lambda n, name: F.format_string(f"%.1f {name}", seconds / n)
    return F.when(seconds < 60, F.format_string("%.0f s", seconds)).when(seconds < 3600, unit(60, "min")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def temporal_burst(peak_events: Column, n_events: Column, burstiness: Column) -> Column:
    """Activity packed into one hour (from five events on) and uneven gaps, in [0, 1]."""
    packed = F.when(n_events >= 5, F.least(F.lit(1.0), peak_events / 10)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * packed + 0.4 * F.greatest(F.lit(0.0), burstiness)))


def escape_markup(text: Column) -> Column:
    """Text for XML and HTML: the five marked characters as entities, and without the control characters that XML refuses."""
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def digest(record: Column) -> Column:
    """SHA-256 of a struct as JSON; name its fields in alphabetical order for a canonical form."""
    return F.sha2(F.to_json(record), 256)


def parse_time(c: Column, unit: float | None = None) -> Column:
    """A timestamp in seconds from a string: an epoch in parts of a second (``unit`` of them; without one, epochs of 1e11 and more are
    milliseconds) or ISO and common date forms; naive times are UTC; null for anything else."""
    number = c.try_cast("double")
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd"]
    text = F.coalesce(c.try_cast("timestamp"), *[F.try_to_timestamp(c, F.lit(f)) for f in forms]).cast("double")
    if unit is not None:
        return F.when(number.isNotNull(), number / unit).otherwise(text)
    return F.when(F.abs(number) >= 1e11, number / 1000).when(number.isNotNull(), number).otherwise(text)


def parse_list(cell: Column) -> Column:
    """Items of a list cell: a JSON list, or text split at | ; , and white space; null and empty give an empty list; a malformed
    JSON list gives null."""
    listed = F.from_json(cell, "array<string>")
    plain = F.filter(F.split(F.coalesce(cell, F.lit("")), r"[|;,\s]+"), lambda x: x != "")
    return F.when(F.trim(cell).startswith("["), listed).otherwise(plain)


def parse_numbers(cell: Column) -> Column:
    """The same as numbers; null if an item is none."""
    items = F.transform(parse_list(cell), lambda x: x.try_cast("double"))
    return F.when(F.exists(items, lambda x: x.isNull()), F.lit(None)).otherwise(items)
