"""Imputing, clipping, scaling and encoding: fitted once, applied as expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrarium.operators import ranks
from agrarium.operators.splits import global_rank

RANGES = 1_024  # of positions, in which categories are numbered
MISSING = "__missing__"


@dataclass(frozen=True)
class Affine:
    """x -> (x - shift) / scale * factor + offset by column; null becomes ``null``."""

    shift: dict[str, float]
    scale: dict[str, float]
    factor: float = 1.0
    offset: float = 0.0
    null: float | None = 0.0

    def of(self, column: str) -> Column:
        x = (F.col(column) - F.lit(self.shift[column])) / F.lit(self.scale[column] or 1.0) * self.factor + self.offset
        return x if self.null is None else F.coalesce(x, F.lit(self.null))

    def inverse(self, column: str) -> Column:
        return (F.col(column) - self.offset) / self.factor * F.lit(self.scale[column] or 1.0) + F.lit(self.shift[column])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.of(c) for c in self.shift})


def _scalars(df: DataFrame, wanted: dict[str, Column]) -> dict[str, float]:
    """Named scalars of one aggregation."""
    return df.agg(*(c.alias(n) for n, c in wanted.items())).first().asDict() if wanted else {}


def standard(df: DataFrame, columns: list[str]) -> Affine:
    x = _scalars(df, {f"{c}|m": F.avg(c) for c in columns} | {f"{c}|s": F.stddev_pop(c) for c in columns})
    return Affine({c: x[f"{c}|m"] or 0.0 for c in columns}, {c: x[f"{c}|s"] or 1.0 for c in columns})


def min_max(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> Affine:
    x = _scalars(df, {f"{c}|a": F.min(c).cast("double") for c in columns} | {f"{c}|b": F.max(c).cast("double") for c in columns})
    return Affine({c: x[f"{c}|a"] or 0.0 for c in columns}, {c: ((x[f"{c}|b"] or 0.0) - (x[f"{c}|a"] or 0.0)) or 1.0 for c in columns}, high - low, low, low)


def robust(df: DataFrame, columns: list[str]) -> Affine:
    x = ranks.quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    q = {c: x.get(c) or [0.0, 0.0, 1.0] for c in columns}
    return Affine({c: q[c][1] for c in columns}, {c: (q[c][2] - q[c][0]) or 1.0 for c in columns})


def fill_values(df: DataFrame, columns: list[str], how: str = "mean") -> dict[str, float]:
    """What stands in for nulls: mean, median, mode (least of the most frequent) or zero."""
    if how == "median":
        found = ranks.quantiles(df, {c: F.col(c) for c in columns}, [0.5])
        return {c: found.get(c, [0.0])[0] for c in columns}
    by = {"mean": F.avg, "mode": lambda c: F.mode(c, True), "zero": lambda c: F.lit(0.0)}[how]
    return {c: v if v is not None else 0.0 for c, v in _scalars(df, {c: by(c) for c in columns}).items()}


def fence(df: DataFrame, columns: list[str], how: str = "iqr", k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Clip bounds: quartiles less and plus k times their distance, or mean and k population deviations."""
    if how == "iqr":
        x = ranks.quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.75])
        return {c: (q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])) for c, q in x.items() if q}
    x = _scalars(df, {f"{c}|m": F.avg(c) for c in columns} | {f"{c}|s": F.stddev_pop(c) for c in columns})
    return {c: (x[f"{c}|m"] - k * x[f"{c}|s"], x[f"{c}|m"] + k * x[f"{c}|s"]) for c in columns if x[f"{c}|m"] is not None}


def clipped(column: Column, bounds: tuple[float, float]) -> Column:
    return F.when(column.isNotNull(), F.greatest(F.least(column, F.lit(bounds[1])), F.lit(bounds[0])))


def categories(df: DataFrame, column: str, position: str) -> DataFrame:
    """(category, code) in the order of first appearance by ``position``, a number; null and blank are one category.

    Codes are ranks within ranges of first positions and the sums of the ranges
    before, so that no task numbers all categories.
    """
    named = df.select(category(F.col(column)).alias("category"), position)
    firsts = named.groupBy("category").agg(F.min(position).alias("first"))
    last = firsts.agg(F.min("first").alias("lo"), F.max("first").alias("hi")).first()
    width = max(1.0, (float(last["hi"]) - float(last["lo"])) / RANGES) if last["hi"] is not None else 1.0
    ranked = global_rank(firsts, [F.col("first"), F.col("category")], F.floor((F.col("first") - F.lit(last["lo"])) / F.lit(width)))
    return ranked.select("category", (F.col("_rank") - 1).cast("int").alias("code"))


def category(column: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(column.cast("string")), F.lit("")), F.lit(MISSING))


def ordinal(df: DataFrame, column: str, known: DataFrame, out: str) -> DataFrame:
    """Codes of ``known``; unseen categories are -1."""
    codes = known.select(F.col("category").alias("_c"), F.col("code").alias(out))
    return df.join(codes, category(F.col(column)) == F.col("_c"), "left").drop("_c").na.fill(-1, [out])


def one_hot(column: str, names: list[str]) -> list[Column]:
    """A 0/1 column for each category; an unseen one has zeros."""
    return [F.when(category(F.col(column)) == n, 1.0).otherwise(0.0).alias(f"{column}={n}") for n in names]


@dataclass
class TabularPipeline:
    """Fill, clip, scale and encode into one vector; constant and correlated columns go first."""

    numeric: list[str]
    categorical: list[str]
    position: str
    drop_constant: bool = True
    most_correlated: float = 0.95
    most_categories: int = 10_000
    fitted: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> TabularPipeline:
        from agrarium.operators.profile import constant_columns, drop_correlated

        numeric = list(self.numeric)
        if self.drop_constant and numeric:
            constant = {r["column"] for r in constant_columns(df, numeric).where("is_constant").collect()}
            numeric = [c for c in numeric if c not in constant]
        if len(numeric) > 1:
            left = drop_correlated(df.select(*numeric), numeric, self.most_correlated).columns
            numeric = [c for c in numeric if c in left]
        fill, bounds = (fill_values(df, numeric), fence(df, numeric)) if numeric else ({}, {})
        ready = df.select(*(clipped(F.coalesce(c, F.lit(fill[c])), bounds.get(c, (-1e308, 1e308))).alias(c) for c in numeric))
        names = {c: self._names(df, c) for c in self.categorical}
        self.fitted = {"numeric": numeric, "fill": fill, "bounds": bounds, "scale": standard(ready, numeric), "names": names}
        return self

    def _names(self, df: DataFrame, column: str) -> list[str]:
        """A vector has an entry for each category, so that there may be ``most_categories`` of them; more are an error, and a column for ``ordinal``."""
        found = categories(df, column, self.position).where(F.col("code") <= self.most_categories).orderBy("code").collect()
        if len(found) > self.most_categories:
            raise ValueError(f"{column} has more than {self.most_categories} categories")
        return [r["category"] for r in found]

    def feature_names(self) -> list[str]:
        return self.fitted["numeric"] + [f"{c}={n}" for c, names in self.fitted["names"].items() for n in names]

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        f = self.fitted
        missing = [c for c in [*f["numeric"], *f["names"]] if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        ready = {c: clipped(F.coalesce(F.col(c).try_cast("double"), F.lit(f["fill"][c])), f["bounds"].get(c, (-1e308, 1e308))) for c in f["numeric"]}
        scaled = [(x - F.lit(f["scale"].shift[c])) / F.lit(f["scale"].scale[c]) for c, x in ready.items()]
        return df.withColumn(out, F.array(*scaled, *(x for c, names in f["names"].items() for x in one_hot(c, names))).cast("array<float>"))
