"""Reproducible splits, folds, samples and plans.

Rows are ordered by a hash of their key and a seed, so that a split doesn't
depend on how Spark dealt the rows. Ranks over a whole table are taken from
counts of hash buckets, never by one sort in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME, SPACE = 2654435761, 2**32


def mark(key: Column, seed: int) -> Column:
    """A number below 2**32 for a whole-number key; any SQL engine can say it."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(SPACE)) * PRIME + F.lit(seed) * 40503, F.lit(SPACE))


def global_rank(df: DataFrame, order: list[Column], bucket: Column) -> DataFrame:
    """``df`` with ``_rank`` from 1 in an order whose leading part is ``bucket``: ranks within buckets, and sums of the counts before."""
    own = df.withColumn("_b", bucket)
    before = own.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return own.withColumn("_i", inside).join(before, "_b").withColumn("_rank", F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")


def class_rank(df: DataFrame, label: str, order: list[Column], bucket: Column) -> DataFrame:
    """``df`` with ``_rank`` from 1 within each label, in an order whose leading part is ``bucket``, and ``_n``, the label's rows; a label's rows are never sorted in one task."""
    own = df.withColumn("_b", bucket)
    by = Window.partitionBy("_l").orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_a")).agg(F.count("*").alias("_c"))
    before = counts.select("_l", "_a", F.coalesce(F.sum("_c").over(by), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy("_l")).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy(*order))
    ranked = own.withColumn("_i", inside).join(before, F.col(label).eqNullSafe(F.col("_l")) & F.col("_b").eqNullSafe(F.col("_a")))
    return ranked.withColumn("_rank", F.col("_before") + F.col("_i")).drop("_a", "_b", "_i", "_l", "_before")


def random_split(df: DataFrame, key: str, test: float, validation: float, seed: int = 42) -> DataFrame:
    """``split`` with exact sizes: round(n * share) rows to test, then to validation."""
    own = mark(F.col(key), seed)
    n = F.lit(df.count())
    ranked = global_rank(df, [own, F.col(key)], F.floor(own / 2**20))
    return ranked.withColumn("split", _parts(F.col("_rank"), n, test, validation)).drop("_rank")


def _parts(rank: Column, n: Column, test: float, validation: float) -> Column:
    first, second = F.round(n * test), F.round(n * validation)
    return F.when(rank <= first, "test").when(rank <= first + second, "validation").otherwise("train")


def stratified_split(df: DataFrame, key: str, label: str, test: float, validation: float, seed: int = 42) -> DataFrame:
    """The same within each class."""
    own = mark(F.col(key), seed)
    ranked = class_rank(df, label, [own, F.col(key)], F.floor(own / 2**20))
    return ranked.withColumn("split", _parts(F.col("_rank"), F.col("_n"), test, validation)).drop("_rank", "_n")


def group_split(df: DataFrame, group: str, test: float, validation: float, seed: int = 42) -> DataFrame:
    """Whole groups go to one side."""
    groups = random_split(df.select(group).distinct(), group, test, validation, seed)
    return df.join(groups, group)


def temporal_split(df: DataFrame, year: Column, test: float, validation: float) -> DataFrame:
    """The last share of the distinct years is the test, the share before it the validation; each at least one year."""
    dated = df.withColumn("_year", year)
    years = dated.select("_year").distinct().withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_year")))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    first, second = F.greatest(F.lit(1), F.round(F.col("_n") * test)), F.greatest(F.lit(1), F.round(F.col("_n") * validation))
    named = years.select("_year", F.when(F.col("_r") <= first, "test").when(F.col("_r") <= first + second, "validation").otherwise("train").alias("split"))
    return dated.join(named, "_year").drop("_year")


def folds(df: DataFrame, key: str, k: int, seed: int = 42, within: str | None = None) -> DataFrame:
    """``fold`` from 0 to k - 1, dealt in turn in the order of the marks, within classes if asked."""
    own = mark(F.col(key), seed)
    if within:
        ranked = class_rank(df, within, [own, F.col(key)], F.floor(own / 2**20)).drop("_n")
    else:
        ranked = global_rank(df, [own, F.col(key)], F.floor(own / 2**20))
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def group_folds(df: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    return df.join(folds(df.select(group).distinct(), group, k, seed), group)


def year_folds(df: DataFrame, year: Column, k: int) -> DataFrame:
    """Distinct years in turn; a null year is in fold 0."""
    dated = df.withColumn("_year", year)
    years = dated.select("_year").where("_year IS NOT NULL").distinct().withColumn("fold", F.pmod(F.row_number().over(Window.orderBy("_year")) - 1, F.lit(k)).cast("int"))
    return dated.join(years, "_year", "left").na.fill(0, ["fold"]).drop("_year")


def ordered_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows of the least marks: a sample that any run draws again."""
    return df.orderBy(mark(F.col(key), seed), key).limit(n)


def holdout(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """``held_out``: max(1, round(n * share)) rows of the least marks."""
    own = mark(F.col(key), seed)
    least = F.greatest(F.lit(1), F.round(F.lit(df.count()) * share))
    return global_rank(df, [own, F.col(key)], F.floor(own / 2**20)).withColumn("held_out", F.col("_rank") <= least).drop("_rank")


def last_values(df: DataFrame, column: str, share: float) -> DataFrame:
    """The last max(1, round(n * share)) of a column's distinct values, which are few."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    n = values.count()
    return values.orderBy(F.desc(column)).limit(max(1, int(n * share + 0.5)))


def drawn(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` draws with replacement: (draw, row's columns); a draw's row is told by a rank from the draw's own mark."""
    ranked = global_rank(df, [mark(F.col(key), seed), F.col(key)], F.floor(mark(F.col(key), seed) / 2**20))
    total = df.count()
    if not total:
        return ranked.select(F.lit(0).cast("long").alias("draw"), *df.columns).limit(0)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod(mark(F.col("id") + 1, seed), F.lit(total)) + 1).alias("_rank"))
    return draws.join(ranked, "_rank").drop("_rank")


def bootstrap(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def plan(locations: DataFrame, years: list[int], seasons: list[str]) -> DataFrame:
    """Every location with every year and season; the two lists are arguments, so nothing is joined."""
    return locations.withColumn("year", F.explode(F.array(*map(F.lit, years)))).withColumn("season", F.explode(F.array(*map(F.lit, seasons))))


def novel(current: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """(column, change): values that only one side has."""
    a, b = current.select(column).distinct(), reference.select(column).distinct()
    return a.join(b, column, "left_anti").withColumn("change", F.lit("novel")).unionByName(b.join(a, column, "left_anti").withColumn("change", F.lit("vanished")))
