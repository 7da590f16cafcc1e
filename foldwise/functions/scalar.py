"""Column expressions (all JVM-side built-ins, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unit_sphere(lat, long) -> tuple[Column, Column, Column]:
    """Latitude/longitude in degrees -> x, y, z on the unit sphere (null in, null out)."""
    la, lo = F.radians(_c(lat)), F.radians(_c(long))
    return (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))


def zip5(statezip) -> Column:
    """First 5-digit run of the text; no match -> NULL."""
    return F.nullif(F.regexp_extract(_c(statezip), r"(\d{5})", 1), F.lit(""))


def renovated_flag(yr_renovated) -> Column:
    """1 when the renovation year is > 0, else 0 (a missing year counts as 0)."""
    return F.coalesce((_c(yr_renovated) > 0).cast("int"), F.lit(0))


def age_at_sale(date, yr_built) -> Column:
    return F.year(F.to_timestamp(_c(date))) - _c(yr_built)


def safe_ratio(num, den) -> Column:
    """num / den, NULL for a zero or missing denominator (ANSI-safe)."""
    return F.try_divide(_c(num), _c(den))


def blend(w, a, b) -> Column:
    """w * a + (1 - w) * b."""
    return _c(w) * _c(a) + (F.lit(1.0) - _c(w)) * _c(b)


def clip(c, lo: float, hi: float) -> Column:
    return F.greatest(F.least(_c(c), F.lit(hi)), F.lit(lo))


def variant_label(variant) -> Column:
    """'tgt' style variants are shown as 'tgt + coord', except 'tgt_only'."""
    v = _c(variant)
    return F.when(v.contains("tgt") & ~v.contains("tgt_only"), F.lit("tgt + coord")).otherwise(v)


def display_label(model, variant) -> Column:
    """'<model> / <variant label>' with 'mgbdt' shown as 'XGBoost'."""
    return F.replace(F.concat_ws(" / ", _c(model), variant_label(variant)),
                     F.lit("mgbdt"), F.lit("XGBoost"))


def argmax(arr) -> Column:
    """0-based position of the first maximum of an array column."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def hash_fraction(seed: int, key) -> Column:
    """Deterministic uniform number in [0, 1) from md5(seed:key)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))), 1, 8),
               16, 10).cast("bigint")
    return h / F.lit(float(1 << 32))


def hash_bucket(seed: int, key, k: int) -> Column:
    """``conv(substr(md5('seed:key'),1,8),16,10) % k`` as int."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))), 1, 8),
               16, 10).cast("bigint")
    return (h % F.lit(k)).cast("int")


def hash_key(seed: int, key) -> Column:
    """md5 text of 'seed:key' (the shuffle order of the splits)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def hash_normal(seed: int, key, salt: str = "") -> Column:
    """Deterministic N(0,1) draw per key (Box-Muller on two md5 uniforms)."""
    k = F.concat(F.lit(f"{seed}:{salt}:"), _c(key).cast("string"))
    h = F.md5(k)
    u1 = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") + F.lit(1)) / F.lit(float((1 << 32) + 1))
    u2 = F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * 3.141592653589793) * u2)


def round_half(c, digits: int) -> Column:
    """``c`` rounded to ``digits``, halves away from zero, in double arithmetic (``round`` on
    doubles goes through a decimal for every value); beyond 2^53 steps a double is left as it is."""
    v, step = _c(c).cast("double"), float(10 ** digits)
    near = F.signum(v) * F.floor(F.abs(v) * F.lit(step) + F.lit(0.5)).cast("double") / F.lit(step)
    return F.when(F.abs(v) < F.lit(2.0 ** 53 / step), near + F.lit(0.0)).otherwise(v)  # no -0
