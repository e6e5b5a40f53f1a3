"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a lookup table is broadcast; a larger one is joined as Spark sees fit.
SMALL_ROWS = 50_000


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """table marked for broadcast after its size is checked, else as it is."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def split_keys(dealt: DataFrame, keys: list[str], block: int) -> DataFrame:
    """dealt with lane: rows of a key of over `block` rows are dealt to pairs of blocks, so that any two of them share a lane
    and no task compares a whole hot key; the rows of other keys have lane 0. Only the counts of hot keys are shared."""
    hot = dealt.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n")).where("_n > 1")
    own = F.pmod(F.xxhash64("id"), F.col("_n"))
    lanes = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: F.least(own, j) * F.col("_n") + F.greatest(own, j))
    x = dealt.join(small(hot), keys, "left")
    return x.withColumn("lane", F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(lanes))).drop("_n")


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Null stays null; greatest and least alone would skip it."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def truthy(c: Column) -> Column:
    """A string that is neither null nor blank, trimmed; else null."""
    t = F.trim(c)
    return F.when(t != "", t)


def person_key(name: Column) -> Column:
    """Names are keys, never features."""
    return F.sha2(F.lower(F.trim(name)).cast("binary"), 256)


def token_set(c: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; two empty ones have 0."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def slug_label(c: Column) -> Column:
    """Upper case, hyphens and blanks as _, runs of _ as one."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"[-\s]", "_"), "_+", "_")


def hash_fraction(token: Column, mod: int) -> Column:
    """The first 8 hex digits of the token's SHA-1, modulo mod."""
    return F.pmod(F.conv(F.substring(F.sha1(token.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(mod))


def floor_rank(values: Column, pct: float) -> Column:
    """The value of a sorted array at index int(n * pct / 100), within the array."""
    n = F.size(values)
    at = F.least(n - 1, F.floor(n * F.lit(pct / 100)).cast("int"))
    return F.when(n > 0, F.element_at(values, at + 1))


def rounded_rank(values: Column, pct: float) -> Column:
    """The value of a sorted array at index round((n - 1) * pct / 100), halves to even."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, F.bround((n - 1) * F.lit(pct / 100), 0).cast("int") + 1))
