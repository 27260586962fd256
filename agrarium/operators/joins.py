"""Joins: chains of tables, intervals, nearest dates, staged names, hierarchies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrarium.functions import patterns
from agrarium.operators.lineage import saved

WHOLE_PARTS = 64  # of a table that expressions without any sure letter meet


def chain(base: DataFrame, steps: list[tuple[DataFrame, list[str], str, str]]) -> DataFrame:
    """Joins (table, keys, how, suffix) one after the other; other shared columns of the table get its suffix. Null keys match each other."""
    for other, keys, how, suffix in steps:
        clash = set(base.columns) & set(other.columns) - set(keys)
        right = other.select(*(F.col(c).alias(f"{c}{suffix}" if c in clash else f"_key_{c}" if c in keys else c) for c in other.columns))
        on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys))
        joined = base.join(right, on, how)
        base = joined.withColumns({k: F.coalesce(k, f"_key_{k}") for k in keys}).drop(*(f"_key_{k}" for k in keys))
    return base


def orphans(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` doesn't have."""
    return left.join(right.select(F.col(right_key).alias("_k")).distinct(), F.col(left_key) == F.col("_k"), "left_anti")


def interval_join(facts: DataFrame, date: str, windows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Facts within each window, both ends included.

    The windows are spread over the months they touch, so that the join is an
    equi-join on the month and not a comparison of all with all.
    """
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))
    spread = windows.withColumn("_month", F.explode(months))
    return facts.withColumn("_month", F.trunc(date, "month")).join(spread, "_month").where(F.col(date).between(F.col(start), F.col(end))).drop("_month")


def nearest_date(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, left_id: str, carry: list[str]) -> DataFrame:
    """For each row of ``left`` the ``carry`` columns of ``right`` with the nearest date of the same key, ties to the earlier one.

    Both tables go through one sort by key, month and date; the last right row
    before and the first after are carried along, so pairs are never multiplied.
    What other months hold comes from one row for each key and month, so that a
    hot key's rows don't meet in one task. Rows without key or date are left out.
    """
    cols = [right_date, *(c for c in carry if c != right_date)]
    mark = F.struct(*(F.col(c) for c in cols))
    rows = left.select(F.col(key), F.col(left_date).alias("_at"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(mark).schema[0].dataType).alias("_mark"))
    marks = right.where(F.col(right_date).isNotNull()).select(F.col(key), F.col(right_date).alias("_at"), F.lit(0).alias("_left"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), mark.alias("_mark"))
    both = rows.unionByName(marks).where(F.col(key).isNotNull() & F.col("_at").isNotNull()).withColumn("_month", F.date_trunc("month", "_at"))
    ends = both.groupBy(key, "_month").agg(F.max("_mark").alias("_last"), F.min("_mark").alias("_first"))
    earlier = Window.partitionBy(key).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(key).orderBy(F.desc("_month")).rowsBetween(Window.unboundedPreceding, -1)
    edges = ends.select(key, "_month", F.last("_last", ignorenulls=True).over(earlier).alias("_prev"), F.last("_first", ignorenulls=True).over(later).alias("_next"))
    order = Window.partitionBy(key, "_month").orderBy("_at", "_left", F.col("_mark"))
    back = Window.partitionBy(key, "_month").orderBy(F.col("_at").desc(), F.col("_left"), F.col("_mark").desc())
    both = both.withColumn("_before", F.last("_mark", ignorenulls=True).over(order)).withColumn("_after", F.last("_mark", ignorenulls=True).over(back)).where("_left = 1")
    both = both.join(edges, [key, "_month"]).withColumns({"_before": F.coalesce("_before", "_prev"), "_after": F.coalesce("_after", "_next")})
    gap = lambda c: F.abs(F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col(f"{c}.{right_date}").cast("timestamp")))
    best = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.coalesce("_after", "_before"))
    found = both.withColumn("_best", best).where("_best IS NOT NULL")
    return found.select("_row.*", *(F.col(f"_best.{c}").alias(c) for c in carry))


def staged_name_match(probes: DataFrame, table: DataFrame, probe: str, name: str, position: str, raw: str | None = None) -> DataFrame:
    """(probe columns, matched name, stage): the first row of the first stage that matches.

    Stages: 1 the name; 2 one part of it between / or |; 3 a substring in either
    case; 4 the probe as a regular expression in either case, on the column
    ``raw`` (the name if none is given). Stages 1 and 2 are equi-joins on the
    parts. Probes they leave unmatched meet the names that hold their first three
    letters, by an equi-join as well, and what is left the texts that hold the
    letters which the expression can't match without; one that isn't valid
    matches nothing.
    """
    return _staged(probes, table, probe, name, position, raw, []).select(*probes.columns, F.col("_m.name").alias("matched"), F.col("_m.stage").alias("stage"))


def letters(low: Column) -> Column:
    """All strings of one to three letters that a text holds."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.array(*(F.substring(low, i, F.lit(n)) for n in (1, 2, 3))))))


def _staged(probes: DataFrame, table: DataFrame, probe: str, name: str, position: str, raw: str | None, within: list[str], plain: Callable[[Column], Column] = F.trim, expression: str | None = None) -> DataFrame:
    """The columns of ``probes`` and _m, a struct of stage, pos and name, among rows that are equal in ``within``.

    ``plain`` is what is done to each part of a name; stage 4 looks for the
    column ``expression`` of the probes (the probe if none is given). A null
    probe has that stage only.
    """
    table = table.withColumnsRenamed({c: f"_w_{c}" for c in within})
    alike = lambda on: reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in within), on)
    match = lambda stage: F.struct(stage.alias("stage"), F.col(position).alias("pos"), F.col(name).alias("name")).alias("_m")
    parts = table.withColumn("_part", F.explode(F.array_distinct(F.concat(F.array(F.trim(name)), F.transform(F.split(name, r"[/|]"), lambda p: plain(F.trim(p)))))))
    found = probes.join(parts, alike(F.col(probe) == F.col("_part"))).select(*probes.columns, match(F.when(F.trim(name) == F.col(probe), 1).otherwise(2)))
    first = saved(found.groupBy(*probes.columns).agg(F.min("_m").alias("_m")))
    without = lambda rest, known: rest.join(known.select(F.col(probe).alias("_p"), *(F.col(c).alias(f"_w_{c}") for c in within)), alike(F.col(probe) == F.col("_p")), "left_anti")
    rest = without(probes, first)
    low = F.lower(F.col(name))
    held = table.withColumn("_h", F.explode(letters(low)))
    asked = rest.withColumn("_g", F.substring(F.lower(probe), 1, 3))
    late = asked.join(held, alike(F.col("_g") == F.col("_h"))).where(low.contains(F.lower(F.col(probe)))).select(*probes.columns, match(F.lit(3))).groupBy(*probes.columns).agg(F.min("_m").alias("_m"))
    late = saved(late)
    last = without(rest, late)
    if raw is None:
        # On the name itself, a probe without signs is a substring or nothing.
        last = saved(last.where(F.col(probe).rlike(r"[\\^$.|?*+()\[\]{}]")))
        if last.isEmpty():
            return first.unionByName(late)
    signs = _by_expression(last, table, expression or probe, raw or name, alike).select(*probes.columns, match(F.lit(4))).groupBy(*probes.columns).agg(F.min("_m").alias("_m"))
    return first.unionByName(late).unionByName(signs)


def _by_expression(asked: DataFrame, table: DataFrame, probe: str, text: str, alike: Callable[[Column], Column]) -> DataFrame:
    """Pairs of rows whose ``text`` an expression of ``asked`` is found in, in either case.

    Every match holds one of a few short strings that the expression tells, so
    both sides meet on those by an equi-join, and only what met is searched.
    Expressions that tell none, such as ".*", meet every row, in parts of the
    table. Java searches for expressions that it reads as Python does, a
    vectorised function for the others.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [patterns.plan_of(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*own, strict=True), (pa.bool_(), pa.bool_(), pa.list_(pa.string())), strict=True))] if own else [b.column(0), pa.array([], pa.bool_()), pa.array([], pa.bool_()), pa.array([], pa.list_(pa.string()))], names=["_pattern", "_valid", "_shared", "_grams"])

    plans = asked.select(F.col(probe).alias("_pattern")).distinct().mapInArrow(plan, "_pattern string, _valid boolean, _shared boolean, _grams array<string>").where("_valid")
    part = F.sequence(F.lit(0), F.lit(WHOLE_PARTS - 1))
    keys = plans.withColumn("_gram", F.explode("_grams")).withColumn("_part", F.explode(F.when(F.col("_gram") == "", part).otherwise(F.array(F.lit(0)))))
    wanted = asked.join(keys, F.col(probe) == F.col("_pattern"))
    low = patterns.folded(F.col(text))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.array(*(F.substring(low, i, F.lit(n)) for n in range(1, patterns.GRAM + 1)))))
    rows = table.where(F.col(text).isNotNull()).withColumn("_held", F.explode(F.array_distinct(F.concat(grams, F.array(F.lit(""))))))
    rows = rows.join(keys.select(F.col("_gram").alias("_held")).distinct(), "_held", "left_semi")
    rows = rows.withColumn("_of", F.when(F.col("_held") == "", F.pmod(F.xxhash64(text), F.lit(WHOLE_PARTS))).otherwise(0).cast("int"))
    met = wanted.join(rows, alike((F.col("_gram") == F.col("_held")) & (F.col("_part") == F.col("_of"))))

    @F.pandas_udf("boolean")
    def searched(expression: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([re.search(p, t, re.IGNORECASE) is not None for p, t in zip(expression, text, strict=True)])

    by_java = met.where(F.col("_shared")).where(F.rlike(F.col(text), F.concat(F.lit(patterns.JAVA), F.col(probe))))
    others = met.where(~F.col("_shared")).where(searched(F.col(probe), F.col(text)))
    return by_java.unionByName(others)


def outer_pairs(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """First row per key and side, paired by key; a missing side has nulls."""
    sides = []
    for side, df in (("left", left), ("right", right)):
        first = df.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("v"))
        sides.append(first.select(*keys, *(F.col(f"v.{c}").alias(f"{side}_{c}") for c in values)))
    return sides[0].join(sides[1], keys, "full_outer")


def pair_issues(columns: list[str]) -> Column:
    """What is wrong with a row of ``outer_pairs``: a side missing, or columns that differ; text is compared in lower case."""
    low = lambda c: F.lower(F.col(c).cast("string"))
    one = [F.when(F.coalesce(*(F.col(f"{side}_{c}").cast("string") for c in columns)).isNull(), f"no_{name}") for side, name in (("left", "ndvi"), ("right", "evi"))]
    return F.array_compact(F.array(*one, *(F.when(low(f"left_{c}") != low(f"right_{c}"), c) for c in columns)))


def parent_chain(nodes: DataFrame, key: str, parent: str, name: str, depth: int) -> DataFrame:
    """(key, path): names from a node up to its root, over at most ``depth`` levels of self-joins."""
    up = nodes.select(F.col(key).alias("_k"), F.col(parent).alias("_p"), F.col(name).alias("_n"))
    walk = nodes.select(F.col(key), F.col(parent).alias("_next"), F.array(F.col(name)).alias("path"))
    for _ in range(depth - 1):
        walk = walk.join(up, F.col("_next") == F.col("_k"), "left").select(key, F.col("_p").alias("_next"), F.concat("path", F.when(F.col("_n").isNotNull(), F.array("_n")).otherwise(F.array().cast("array<string>"))).alias("path"))
    return walk.select(key, "path")


def root_paths(nodes: DataFrame, key: str, parent: str, name: str, rounds: int = 40) -> DataFrame:
    """(key, path): names from a node up to its root, over any number of levels.

    By pointer doubling over ids: in round r each node knows its ancestor 2**r
    levels up. A round in which no further node reaches its end shows that all
    others are on a loop or lead to one; these are left out before any path is
    made, so that nothing grows with a loop. Then (node, ancestor, distance)
    doubles likewise, and names are joined once, at the end. A path ends where
    the parent is null or not a node. Of rows of one key the least counts.
    """
    rows = saved(nodes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(F.col(parent).alias("_p"), F.col(name).alias("_n"))).alias("_r")).select("_k", "_r.*"))
    known = rows.select(F.col("_k").alias("_p"))
    jumps = [saved(rows.join(known, "_p", "left_semi").select("_k", F.col("_p").alias("_j")))]  # nodes at an end have no jump
    reached, open_ = rows.count(), jumps[0].count()
    while open_ and open_ < reached and len(jumps) < rounds:
        last = jumps[-1]
        jumps.append(saved(last.join(last.select(F.col("_k").alias("_j"), F.col("_j").alias("_to")), "_j").select("_k", F.col("_to").alias("_j"))))
        reached, open_ = open_, jumps[-1].count()
    # Whoever still has a jump never comes to an end.
    endless = jumps[-1].select("_k") if open_ else None
    finite = lambda df: df.join(endless, "_k", "left_anti") if endless is not None else df
    above = finite(rows.select("_k", F.col("_k").alias("_a"), F.lit(0).cast("long").alias("_d")))
    for r, jump in enumerate(jumps[:-1] if endless is None else jumps):
        step = finite(jump).select(F.col("_k").alias("_from"), F.col("_j").alias("_k"))
        above = saved(above.unionByName(step.join(above, "_k").select(F.col("_from").alias("_k"), "_a", (F.col("_d") + 2**r).alias("_d"))))
    named = above.join(rows.select(F.col("_k").alias("_a"), "_n"), "_a")
    path = F.transform(F.array_sort(F.collect_list(F.struct("_d", "_n"))), lambda x: x["_n"])
    return named.groupBy("_k").agg(path.alias("path")).select(F.col("_k").alias(key), "path")


def historical_lookup(probes: DataFrame, history: DataFrame, place: str, within: str, season: str, year: str, carry: list[str]) -> DataFrame:
    """``probes`` with the ``carry`` columns of the history's row of the same place that fits best, and how many years it is off.

    Rows of the same ``within`` (district) count before others, then those of the
    same season, then the nearest year, the earlier of two, then the least carried
    values. History is cut to one
    row for each place, district, season and year before it meets the probes.
    """
    keys = [place, within, season, year]
    rows = history.groupBy(*keys).agg(F.min(F.struct(*carry)).alias("_c")).withColumnsRenamed({c: f"_h_{c}" for c in keys})
    off = F.abs(F.col(year) - F.col(f"_h_{year}"))
    differs = lambda c: (~F.col(c).eqNullSafe(F.col(f"_h_{c}"))).cast("int")
    rank = F.struct(differs(within).alias("d"), differs(season).alias("s"), off.alias("off"), F.col(f"_h_{year}").alias("year"), F.col("_c"))
    found = probes.join(rows, F.col(place) == F.col(f"_h_{place}"), "left")
    best = found.groupBy(*probes.columns).agg(F.min_by(F.struct(off.alias("off"), "_c"), F.when(F.col(f"_h_{place}").isNotNull(), rank)).alias("_b"))
    return best.select(*probes.columns, F.col("_b.off").alias("years_off"), *(F.col(f"_b._c.{c}").alias(c) for c in carry))
