"""Scalar rules as column expressions. Halves round to even; ticks and bars may be negative."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ticks of a beat and of a bar, tolerances in ms, length of a feature frame in ms.
TICKS_PER_BEAT, TICKS_PER_BAR = 48, 192
EPS, TIE = 1e-6, 1e-12
FRAME_MS = 256 / 22050 * 1000


def lane_of_x(x: Column, lanes: int = 4) -> Column:
    """Lane of a horizontal position on a field 512 wide, truncated toward zero and clamped."""
    return F.greatest(F.lit(0), F.least(F.lit(lanes - 1), (x / 512 * lanes).cast("int")))


def beat_length_to_bpm(length: Column) -> Column:
    """Null for a length that isn't positive."""
    return F.when(length > 0, 60000.0 / length)


def canonical_bpm(bpm: Column) -> Column:
    """struct(bpm, exponent): folded into [120, 240) by a power of two; bpm = canonical * 2**-exponent."""
    raw = -F.floor(F.log2(bpm / 120.0))
    folded = bpm * F.pow(F.lit(2.0), raw)
    fix = F.when(folded < 120, 1).when(folded >= 240, -1).otherwise(0)
    return F.when(bpm > 0, F.struct((folded * F.pow(F.lit(2.0), fix)).alias("bpm"), (raw + fix).cast("int").alias("exponent")))


def ms_to_tick(ms: Column, offset: Column, bpm: Column) -> Column:
    return F.rint((ms - offset) * bpm / 60000.0 * TICKS_PER_BEAT).cast("long")


def tick_to_ms(tick: Column, offset: Column, bpm: Column) -> Column:
    return offset + tick * 60000.0 / bpm / TICKS_PER_BEAT


def split_tick(tick: Column) -> Column:
    """struct(bar, pos) by floor division."""
    return F.struct(F.floor(tick / TICKS_PER_BAR).alias("bar"), F.pmod(tick, F.lit(TICKS_PER_BAR)).alias("pos"))


def reduced(numer: Column, denom: Column, most: int = 144) -> Column:
    """struct(numer, denom): the fraction in lowest terms, for a positive denominator up to ``most``; so 1/3 and 2/6 are equal."""
    common = F.array_max(F.filter(F.array(*map(F.lit, range(1, most + 1))), lambda d: (F.pmod(numer, d) == 0) & (F.pmod(denom, d) == 0)))
    return F.when((denom > 0) & (denom <= most), F.struct((numer / common).cast("long").alias("numer"), (denom / common).cast("long").alias("denom")))


def snap_denominator(tick: Column) -> Column:
    """n of the coarsest 1/n beat that a tick lies on: 48 / gcd(48, tick mod 48)."""
    position = F.pmod(tick, F.lit(TICKS_PER_BEAT))
    return reduce(lambda out, n: F.when(F.pmod(position * n, F.lit(TICKS_PER_BEAT)) == 0, n).otherwise(out), (24, 16, 12, 8, 6, 4, 3, 2, 1), F.lit(48))


def snap_hits(position: Column, most: int = 24) -> Column:
    """Array of flags: whether the position lies on 1/n of a beat, for n from 1 to ``most``."""
    return F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.pmod(position * n, F.lit(TICKS_PER_BEAT)) == 0)


def bpm_band(bpm: Column, width: int = 10) -> Column:
    return F.floor(bpm / width) * width


def quantize_error(ms: Column, offset: Column, bpm: Column) -> Column:
    """struct(tick, error, abs_error, exact) of putting a time on the lattice."""
    tick = ms_to_tick(ms, offset, bpm)
    error = tick_to_ms(tick, offset, bpm) - ms
    return F.struct(tick.alias("tick"), error.alias("error"), F.abs(error).alias("abs_error"), (F.abs(error) < EPS).alias("exact"))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The first rule that holds names the reason; null when none does."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules])


def error_reason(error: Column, prefixes: dict[str, str], otherwise: str = "other") -> Column:
    """A reason code for an error text, by its prefix; null stays null."""
    out = F.lit(otherwise)
    for prefix, reason in reversed(prefixes.items()):
        out = F.when(error.startswith(prefix), reason).otherwise(out)
    return F.when(error.isNotNull(), out)


def clipped_ratio(value: Column, scale: float, most: float = 1.5) -> Column:
    """value / scale in [0, most]; null unless present and finite."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(most), value / scale)))


def log_tempo(bpm: Column) -> Column:
    return (F.log(bpm) - F.log(F.lit(180.0))) / 0.5


def relative_position(t: Column, start: Column, end: Column) -> Column:
    return (t - start) / (end - start)


def frame_index(ms: Column, frame_ms: float = FRAME_MS) -> Column:
    """Frames begun by ``ms``; a quotient within 1e-8 of a whole number counts as whole."""
    q = ms / frame_ms
    return F.when(F.abs(q - F.rint(q)) <= 1e-8, F.rint(q)).otherwise(F.ceil(q)).cast("long")


def parent_path(path: Column) -> Column:
    """Directory of a relative path; null at the root, which is no group."""
    return F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def within_ranges(ranges: dict[str, tuple[float, float]], allowed: set[str] | None = None) -> Column:
    """Every named field present and inside [low, high]; a field outside ``allowed`` is an error."""
    if allowed is not None and set(ranges) - allowed:
        raise ValueError(f"fields that can't be selected on: {sorted(set(ranges) - allowed)}")
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(f).between(*r), F.lit(False)) for f, r in ranges.items()], F.lit(True))


def ratio(hits: Column, total: Column) -> Column:
    """hits / total, 0 where there is nothing to count."""
    return F.when(total > 0, hits / total).otherwise(F.lit(0.0))


def finite(x: Column) -> Column:
    """The value if finite, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def token_class(token: Column) -> Column:
    """bar, pos, row, eos or other; null for framing tokens."""
    return F.when(token.isin("<BOS>", "<PAD>"), None).when(token == "<EOS>", "eos").when(token.startswith("BAR"), "bar").when(token.startswith("BEAT"), "bar").when(token.startswith("POS"), "pos").when(token.startswith("ROW"), "row").otherwise("other")


def mirror_row(token: Column) -> Column:
    """A row token with its lane digits in reverse; other tokens stay."""
    return F.when(token.startswith("ROW_"), F.concat(F.lit("ROW_"), F.reverse(F.substr(token, F.lit(5))))).otherwise(token)


def check_ratios(ratios: dict[str, float]) -> dict[str, float]:
    """Three named shares, none negative, that sum to 1 within 1e-6."""
    if set(ratios) != {"train", "val", "test"} or min(ratios.values()) < 0 or abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError(f"not split ratios: {ratios}")
    return ratios


def bernoulli_mask(fields: list[str], present: dict[str, Column], keep: float, *seed: Column | str | int) -> Column:
    """Array of 0/1 flags: each present field kept with probability ``keep``; of two present fields or more, never none or all."""
    from .hashing import hash_unit

    draws = [F.when(present[f], (hash_unit(*seed, f) < keep).cast("int")).otherwise(0) for f in fields]
    n = reduce(lambda a, b: a + b, [present[f].cast("int") for f in fields])
    kept = reduce(lambda a, b: a + b, draws)
    first = F.coalesce(*[F.when(present[f], i) for i, f in enumerate(fields)])
    mask = [F.when((n >= 2) & (kept == 0) & (first == i), 1).when((n >= 2) & (kept == n) & (first == i), 0).otherwise(d) for i, d in enumerate(draws)]
    return F.array(*mask)


def train_mask(fields: list[str], present: dict[str, Column], *seed: Column | str | int) -> Column:
    """A tenth of rows keep all, a tenth none, the others each field by half; missing fields stay off."""
    from .hashing import hash_unit

    mode = hash_unit(*seed, "mode")
    return F.array(*[F.when(~present[f] | mode.between(0.1, 0.2), 0).when(mode < 0.1, 1).otherwise((hash_unit(*seed, f) < 0.5).cast("int")) for f in fields])


def augment_choice(*seed: Column | str | int) -> Column:
    """struct(mirror, rate): mirrored half the time; a fifth of rows at a rate in [1, 1.5)."""
    from .hashing import hash_unit

    return F.struct((hash_unit(*seed, "mirror") < 0.5).alias("mirror"), F.when(hash_unit(*seed, "change") < 0.2, 1 + 0.5 * hash_unit(*seed, "rate")).otherwise(1.0).alias("rate"))


def clock_time(t: Column, rate: Column) -> Column:
    """A time at another rate, halves up."""
    return F.floor(t / rate + 0.5).cast("long")


def clock_notes(notes: DataFrame, rate: float) -> DataFrame:
    """Notes (time_ms, end_time_ms) at another rate; a hold that would collapse lasts 1 ms."""
    start, end = clock_time(F.col("time_ms"), F.lit(rate)), clock_time(F.col("end_time_ms"), F.lit(rate))
    return notes.withColumn("end_time_ms", F.when(F.col("end_time_ms").isNotNull(), F.greatest(end, start + 1))).withColumn("time_ms", start)
