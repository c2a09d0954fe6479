"""The one deterministic hash that sampling, donors and resampling draw from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_int(*parts: Column | str | int) -> Column:
    """A number below 2**32 from the parts, alike on every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[_text(p) for p in parts])), 1, 8), 16, 10).cast("long")


def hash_unit(*parts: Column | str | int) -> Column:
    """The same as a double in [0, 1)."""
    return hash_int(*parts) / F.lit(float(1 << 32))


def split_position(seed: int, group: Column) -> Column:
    """Position of a group in [0, 1): the first 64 bits of sha256("seed:group")."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), group.cast("string")), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def _text(part: Column | str | int) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))
