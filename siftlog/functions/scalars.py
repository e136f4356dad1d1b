"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Z95 = 1.959963984540054


def seconds_between(start: str, end: str) -> Column:
    """Seconds from one timestamp to another with microseconds, as a double."""
    return F.expr(f"cast(timestampdiff(MICROSECOND, {start}, {end}) as double) / 1000000")


def isoformat(ts: str) -> Column:
    """ISO text in UTC; microseconds only where they are not zero."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")), F.lit("+00:00"))


def wilson(successes: str, total: str, upper: bool) -> Column:
    """Bound of the 95 % Wilson interval within [0, 1]; null without trials."""
    n, p, z2 = f"cast({total} as double)", f"(cast({successes} as double) / nullif({total}, 0))", Z95 * Z95
    centre, spread = f"({p} + {z2} / (2 * {n}))", f"({Z95} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})))"
    return F.expr(f"if({total} = 0, null, greatest(0D, least(1D, ({centre} {'+' if upper else '-'} {spread}) / (1 + {z2} / {n}))))")


def keyed_handle(salt: bytes, kind: Column, identifier: Column, digits: int = 10) -> Column:
    """``kind-`` and the first hex digits of HMAC-SHA256(salt, kind NUL identifier), from two SHA-256 calls."""
    key = (salt if len(salt) <= 64 else __import__("hashlib").sha256(salt).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    message = F.concat(kind.cast("binary"), F.lit(b"\0"), identifier.cast("binary"))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return F.concat(kind, F.lit("-"), F.substring(digest, 1, digits))
