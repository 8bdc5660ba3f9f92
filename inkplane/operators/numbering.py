"""Numbers without gaps, capped attempts, splits and samples, none of them in a single task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplane.functions import draws

#: Rows that are numbered together, about; parts of a table at most, by a tree of FAN at each of two levels.
CHUNK, FAN = 1 << 16, 32
TRIES_PER_PAGE = 20


def quantiles(df: DataFrame, by: str, parts: int) -> list[int]:
    """Whole numbers that cut the values of ``by`` into about ``parts`` equal parts, wherever they lie; fewer where values repeat."""
    if parts < 2:
        return []
    shares = [k / parts for k in range(1, parts)]
    found = df.agg(F.percentile_approx(by, F.array(*[F.lit(x) for x in shares]), F.lit(50 * parts)).alias("cuts")).first().cuts
    return sorted({int(c) for c in found or ()})


def part_of(v: Column, cuts: list[int]) -> Column:
    """How many of the rising ``cuts`` are at most ``v``."""
    many = lambda of: F.size(F.filter(of, lambda c: c <= v))
    number = lambda of: F.array(*[F.lit(c).cast("long") for c in of])
    if not cuts:
        return F.lit(0)
    if len(cuts) <= FAN:
        return many(number(cuts))
    step = -(-len(cuts) // FAN)
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    outer = many(number(g[0] for g in groups))
    return F.when(outer == 0, 0).otherwise((outer - 1) * step + many(F.get(F.array(*[number(g) for g in groups]), outer - 1)))


def dense(df: DataFrame, by: str, start: int | Column = 0, name: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """``df`` numbered from ``start`` in order of the whole-numbered, unique column ``by``.

    Rows are numbered within parts of about ``chunk`` rows, cut at quantiles of the keys,
    FAN * FAN of them at most; the small table of counts adds up what lies before. A count
    and the quantiles are worked out at once.
    """
    rows = df.withColumn("_chunk", part_of(F.col(by), quantiles(df, by, min(FAN * FAN, -(-df.count() // chunk)))))
    sizes = rows.groupBy("_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_chunk").orderBy(by)) - 1
    start = F.lit(start) if isinstance(start, int) else start
    return rows.withColumn("_own", own).join(sizes, "_chunk").withColumn(name, (F.col("_before") + F.col("_own") + start).cast("long")).drop("_chunk", "_own", "_before")


def successes(attempts: DataFrame, amount: Column, start: int | Column = 0) -> DataFrame:
    """The first ``amount`` rows of (attempt from 1, ok) that are ok, among the first 20 * amount, with their idx."""
    start = F.lit(start) if isinstance(start, int) else start
    tried = attempts.filter((F.col("attempt") <= amount * TRIES_PER_PAGE) & F.col("ok"))
    return dense(tried, "attempt").filter(F.col("idx") < amount).withColumn("idx", F.col("idx") + start)


def split_sizes(n: Column, ratio: float) -> Column:
    """(n_train, n_val): one for validation at least, the rest for training, which may be negative for none at all."""
    val = F.greatest(F.lit(1).cast("long"), F.floor(n.cast("double") * F.lit(float(ratio))))
    return F.struct((n.cast("long") - val).alias("n_train"), val.alias("n_val"))


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows at most, without replacement, with ``sample_no`` from 1."""
    u = draws.uniform(seed, "sample", key)
    top = df.withColumn("_u", u).orderBy("_u", key).limit(n)  # a top-n: every task passes n rows on
    return top.withColumn("sample_no", F.row_number().over(Window.orderBy("_u", key))).drop("_u")


@dataclass(frozen=True)
class Population:
    """Numbered rows to draw from, as often as one likes."""

    rows: DataFrame
    size: int

    @classmethod
    def of(cls, df: DataFrame, by: str) -> Population:
        """Numbered by the whole-numbered, unique column ``by``; an error for none."""
        size = df.count()
        if not size:
            raise ValueError("nothing to draw from")
        return cls(dense(df, by, name="_pick"), size)

    def draw(self, df: DataFrame, seed: int, key: str, *within: str) -> DataFrame:
        """Every row of ``df`` with one of these, by an equi-join on the number drawn, and on the columns ``within`` where each of their values has all numbers."""
        number = F.floor(draws.uniform(seed, "pick", key) * F.lit(self.size)).cast("long")
        picked = df.withColumn("_pick", F.coalesce(number, F.lit(-1)))  # never null, so no filter draws once more
        return picked.join(self.rows, ["_pick", *within]).drop("_pick")


def draw_with_replacement(df: DataFrame, population: DataFrame, seed: int, key: str, by: str) -> DataFrame:
    """Every row of ``df`` with a row of ``population``, an error for an empty one."""
    return Population.of(population, by).draw(df, seed, key)


def first_accepted(candidates: DataFrame, key: str, attempt: str, accepted: Column, tries: int, take: list[str]) -> DataFrame:
    """For each key the columns ``take`` of its first accepted candidate within ``tries``; keys without one are absent."""
    fine = candidates.filter((F.col(attempt) <= tries) & accepted)
    best = fine.groupBy(key).agg(F.min(F.struct(attempt, *take)).alias("_best"))
    return best.select(key, F.col(f"_best.{attempt}").alias(attempt), *[F.col(f"_best.{c}").alias(c) for c in take])
