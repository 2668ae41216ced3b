"""Scalar and array helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclidean(a: Column, b: Column) -> Column:
    """Distance over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    squares = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def nearest_rank(x: str, p: float) -> Column:
    """The smallest value that at least a share p of the rows does not exceed."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero: engines sum in different orders."""
    return F.round(x, digits) + F.lit(0.0)


def device_of(key: Column) -> Column:
    """The device of a key "device#number", as keys are written that spread one device's rows."""
    return F.substring_index(key, "#", 1)


def local_day(ts: Column, zone: str = "Europe/London") -> Column:
    """The local calendar day of epoch seconds."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(ts), zone))


def local_hour(ts: Column, zone: str = "Europe/London") -> Column:
    return F.hour(F.from_utc_timestamp(F.timestamp_seconds(ts), zone))


def day_start(day: Column, zone: str = "Europe/London") -> Column:
    """Epoch seconds at which a local day begins: days have 23, 24 or 25 hours."""
    return F.unix_timestamp(F.to_utc_timestamp(day.cast("timestamp"), zone))


def murmur2(text: Column) -> Column:
    """The 32-bit Murmur2 hash of a string's bytes that keyed topics are dealt by, from -2**31 to 2**31 - 1.

    Arithmetic is on longs kept to 32 bits; a product of two such numbers fits, as the multiplier has 31 bits.
    """
    seed, factor, mask = 0x9747B28C, 0x5BD1E995, 0xFFFFFFFF  # fixed values
    digits, n = F.hex(text.cast("binary")), F.octet_length(text)
    byte = lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("long")
    times = lambda x: (x * F.lit(factor)).bitwiseAND(F.lit(mask))
    folded = lambda x, bits: x.bitwiseXOR(F.shiftright(x, bits))

    def word(h: Column, k: Column) -> Column:
        value = byte(4 * k) + byte(4 * k + 1) * 256 + byte(4 * k + 2) * 65_536 + byte(4 * k + 3) * 16_777_216
        return times(h).bitwiseXOR(times(folded(times(value), 24)))

    start = F.lit(seed).cast("long").bitwiseXOR(n.cast("long"))
    whole = (n / 4).cast("int")
    h = F.when(whole > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), start, word)).otherwise(start)
    rest, at = n % 4, whole * 4
    tail = byte(at) + F.when(rest > 1, byte(at + 1) * 256).otherwise(0) + F.when(rest > 2, byte(at + 2) * 65_536).otherwise(0)
    h = F.when(rest > 0, times(h.bitwiseXOR(tail))).otherwise(h)
    h = folded(times(folded(h, 13)), 15)
    return F.when(h >= 2**31, h - 2**32).otherwise(h)
