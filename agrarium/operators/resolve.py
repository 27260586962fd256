"""Resolution of places and of tabular rows: candidates of several strategies, ranked, the first that has any counts."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrarium.functions.names import as_double, as_year, normal_name
from agrarium.operators import joins, spatial
from agrarium.operators.lineage import saved

STRATEGIES = ("name", "prefix", "radius", "box", "nearest")


def by_name(probes: DataFrame, places: DataFrame, name: str, place_name: str) -> DataFrame:
    """All (probe, place) of equal name, ignoring case and outer blanks, else of places whose name begins with the probe's; ``strategy`` is 1 or 2.

    Beginnings meet on their first three letters.
    """
    asked = probes.where(F.col(name).isNotNull()).withColumn("_key", F.lower(F.trim(name)))
    held = places.where(F.col(place_name).isNotNull()).withColumn("_name", F.lower(F.trim(place_name)))
    exact = asked.join(held, F.col("_key") == F.col("_name")).withColumn("strategy", F.lit(1))
    rest = asked.join(held.select(F.col("_name").alias("_known")).distinct(), F.col("_key") == F.col("_known"), "left_anti")
    begins = held.withColumn("_g", F.explode(F.array_distinct(F.array(*(F.substring("_name", 1, n) for n in (0, 1, 2, 3))))))
    late = rest.join(begins, F.substring("_key", 1, 3) == F.col("_g")).where(F.col("_name").startswith(F.col("_key"))).drop("_g").withColumn("strategy", F.lit(2))
    return exact.unionByName(late).drop("_key", "_name")


def located(probes: DataFrame, places: DataFrame, key: str, place_key: str, km: float | None = None, tolerance: float = 0.01, k: int = 1) -> DataFrame:
    """(key, place_key, strategy, rank, distance_km): the places of the first strategy that finds any, best first.

    Probes (key, name, kind, lon, lat) and places (place_key, place_name,
    place_kind, place_lon, place_lat). By name, then by its beginning, places of
    the probe's kind before others; else by coordinates within ``km`` if given,
    in a box of ``tolerance`` degrees, and at last the ``k`` nearest. The row of
    rank 1 is the place; a probe that nothing finds has one row of nulls.
    """
    named = by_name(probes, places, "name", "place_name").select(key, place_key, "strategy", (~F.col("kind").eqNullSafe(F.col("place_kind"))).cast("int").alias("_other"), F.lit(None).cast("double").alias("distance_km"))
    named = saved(named)
    left = saved(probes.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(key, "lon", "lat").join(named.select(key).distinct(), key, "left_anti"))
    spots = places.where(F.col("place_lon").isNotNull() & F.col("place_lat").isNotNull()).select(place_key, "place_lon", "place_lat")
    found = [named]

    def take(rows: DataFrame, strategy: int) -> None:
        nonlocal left
        rows = saved(rows.select(key, place_key, F.lit(strategy).alias("strategy"), F.lit(0).alias("_other"), "distance_km"))
        found.append(rows)
        left = saved(left.join(rows.select(key).distinct(), key, "left_anti"))

    if km is not None:
        take(spatial.within_radius(left, spots, km), 3)
    take(_in_box(left, spots, tolerance), 4)
    take(spatial.nearest(left, spots, key, place_key, k), 5)
    order = Window.partitionBy(key).orderBy("_other", F.col("distance_km").asc_nulls_first(), place_key)
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).drop("_other")
    names = F.element_at(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    return probes.select(key).join(ranked.withColumn("strategy", names), key, "left")


def _in_box(points: DataFrame, places: DataFrame, tolerance: float) -> DataFrame:
    """Pairs at most ``tolerance`` degrees apart in both coordinates, with distance_km."""
    from agrarium.functions.geo import cell, haversine

    near = lambda c: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: cell(F.col(c), tolerance) + i))
    asked = points.withColumn("_x", near("lon")).withColumn("_y", near("lat"))
    offered = places.withColumn("_x", cell(F.col("place_lon"), tolerance)).withColumn("_y", cell(F.col("place_lat"), tolerance))
    inside = (F.abs(F.col("lon") - F.col("place_lon")) <= tolerance) & (F.abs(F.col("lat") - F.col("place_lat")) <= tolerance)
    return asked.join(offered, ["_x", "_y"]).where(inside).drop("_x", "_y").withColumn("distance_km", haversine(F.col("lon"), F.col("lat"), F.col("place_lon"), F.col("place_lat")))


def tabular_match(probes: DataFrame, tables: list[DataFrame], key: str, levels: Sequence[str], within: list[str], position: str, carry: list[str], holds: str | None = None, plain: Callable[[Column], Column] | None = None) -> DataFrame:
    """(probe columns, level, source, carried columns): the row of the first table and level whose name matches.

    Tables are taken in order; in each the names of ``levels`` (village, taluk,
    district) in order, by the stages of staged_name_match among rows equal in
    ``within``; the second level counts where it differs from the first. A probe
    that no table answers has the first row of the first table with any row equal
    in ``within``, at level "none"; without any such row it has nulls.

    The column ``holds`` of ``within``, a season, need not be equal: the table's
    text has to hold the probe's, in either case, and a blank probe takes every
    row. Names are compared as ``plain`` makes them (aliases, parentheses); the
    last stage looks for the probe's name as given in the table's as given.
    """
    equal = lambda pairs: reduce(Column.__and__, (F.col(a).eqNullSafe(F.col(b)) for a, b in pairs))
    rank = lambda last, level, pos: F.struct(F.lit(last).alias("last"), F.col("_src").alias("source"), level.alias("level"), F.col(pos).cast("long").alias("pos")).alias("_r")
    said = plain or (lambda c: c)
    given, held = probes, tables
    if holds:
        given = probes.withColumn(holds, F.nullif(F.trim(holds), F.lit("")))
        held = _answering(given, tables, holds)
    # One table of all names and one of all probes: tables and levels are keys like those of ``within``, and each stage runs once.
    long = reduce(DataFrame.unionByName, (t.select(F.lit(i).alias("_src"), F.lit(j).alias("_lvl"), F.col(position).cast("long").alias("_pos"), F.col(level).alias("_text"), said(F.col(level)).alias("_name"), *within) for i, t in enumerate(held) for j, level in enumerate(levels)))
    # Of rows of one name the first is the one that is found, so a name is looked at once, however many rows bear it.
    long = long.groupBy("_src", "_lvl", "_text", "_name", *within).agg(F.min("_pos").alias("_pos"))
    other = lambda j, level: (F.trim(level) != "") & (F.lit(True) if j != 1 else ~F.col(level).eqNullSafe(F.col(levels[0])))
    pairs = F.array_compact(F.array(*(F.when(other(j, level), F.struct(F.lit(j).alias("_lvl"), F.trim(level).alias("_raw"))) for j, level in enumerate(levels))))
    asked = given.select(key, *within, F.explode(pairs).alias("_p")).select(key, *within, "_p.*")
    names = saved(asked.select("_raw", F.nullif(said(F.col("_raw")), F.lit("")).alias("_probe"), "_lvl", *within).distinct().withColumn("_src", F.explode(F.array(*(F.lit(i) for i in range(len(tables)))))))
    own = [*within, "_src", "_lvl"]
    hits = joins._staged(names, saved(long), "_probe", "_name", "_pos", *(("_text", own, plain, "_raw") if plain else (None, own)))
    hits = hits.select(F.col("_raw").alias("_h_raw"), F.col("_lvl").alias("_h_lvl"), *(F.col(c).alias(f"_h_{c}") for c in within), "_src", F.col("_m.pos").alias("_pos"))
    tried = asked.join(hits, (F.col("_raw") == F.col("_h_raw")) & (F.col("_lvl") == F.col("_h_lvl")) & equal([(c, f"_h_{c}") for c in within])).select(key, rank(0, F.col("_lvl"), "_pos"))
    start = reduce(DataFrame.unionByName, (t.groupBy(*(F.col(c).alias(f"_h_{c}") for c in within)).agg(F.min(F.col(position).cast("long")).alias("_pos")).withColumn("_src", F.lit(i)) for i, t in enumerate(held)))
    begun = given.join(start, equal([(c, f"_h_{c}") for c in within])).select(key, rank(1, F.lit(-1), "_pos"))
    best = tried.unionByName(begun).groupBy(key).agg(F.min("_r").alias("_r"))
    rows = reduce(DataFrame.unionByName, (t.select(F.lit(i).alias("_t"), F.col(position).cast("long").alias("_pos"), *carry) for i, t in enumerate(tables)))
    title = F.when(F.col("_r.level") < 0, "none").otherwise(F.element_at(F.array(*map(F.lit, levels)), F.greatest(F.col("_r.level"), F.lit(0)) + 1))
    found = best.join(rows, (F.col("_r.source") == F.col("_t")) & (F.col("_r.pos") == F.col("_pos"))).select(key, title.alias("level"), F.col("_r.source").alias("source"), *carry)
    return probes.join(found, key, "left")


def _answering(asked: DataFrame, tables: list[DataFrame], column: str) -> list[DataFrame]:
    """The rows of each table once for each text asked that their ``column`` holds, which stands in its place; for null, if asked, every row.

    Texts asked and texts held are distinct before they meet on three letters.
    """
    wanted = saved(asked.select(F.col(column).alias("_asked")).distinct())
    texts = reduce(DataFrame.unionByName, (t.select(F.col(column).alias("_held")) for t in tables)).where("_held IS NOT NULL").distinct()
    offered = texts.withColumn("_g", F.explode(joins.letters(F.lower("_held"))))
    met = wanted.withColumn("_g", F.substring(F.lower("_asked"), 1, 3)).join(offered, "_g").where(F.lower("_held").contains(F.lower("_asked")))
    met = saved(met.select("_asked", "_held"))
    spread = [t.join(met, F.col(column) == F.col("_held")).withColumn(column, F.col("_asked")).drop("_asked", "_held") for t in tables]
    if wanted.where("_asked IS NULL").isEmpty():
        return spread
    return [s.unionByName(t.withColumn(column, F.lit(None).cast("string"))) for s, t in zip(spread, tables, strict=True)]


@dataclass(frozen=True)
class Tabular:
    """A table and where its crop and its yield stand; one that lacks either is wide, with columns "<CROP> AREA (unit)" and "<CROP> YIELD (unit)". ``features`` names the fields to hand on."""

    frame: DataFrame
    crop: str | None = None
    yields: str | None = None
    features: tuple[str, ...] = ()


#: Headings of wide tables.
WIDE = {"area": r"(?i)^(.*?)\s+AREA\s*\(", "yield": r"(?i)^(.*?)\s+YIELD\s*\("}


def wide_crops(columns: Sequence[str]) -> dict[str, dict[str, str]]:
    """The columns of area and yield of each crop that the headings of a wide table name, in their order, crops with an area first."""
    found: dict[str, dict[str, str]] = {}
    for kind, pattern in WIDE.items():
        for c in columns:
            if m := re.match(pattern, c):
                found.setdefault(m[1].strip(), {})[kind] = c
    return found


def tabular_record(source: Tabular, district: str, year: str) -> Column:
    """struct(crop, yield_value, fields) of a table's rows.

    A wide row's crop is the one of the largest positive area, with its yield
    whatever that is; without any, the one of the largest positive yield, and no
    area. ``fields`` are the features named, else what was derived of a wide row,
    else all columns, as text.
    """
    columns, text = source.frame.columns, lambda c: c.cast("string")
    best = None
    if not (source.crop and source.yields):
        number = lambda c: F.col(f"`{c}`").try_cast("double") if c else F.lit(None).cast("double")
        crops = [(name, number(c.get("area")), number(c.get("yield"))) for name, c in wide_crops(columns).items()]
        rows = F.array(*(F.struct(F.lit(name).alias("name"), a.alias("area"), y.alias("value"), F.lit(-i).alias("at")) for i, (name, a, y) in enumerate(crops))) if crops else F.array().cast("array<struct<name: string, area: double, value: double, at: int>>")
        top = lambda by: F.array_max(F.transform(F.filter(rows, lambda r: ~F.isnan(r[by]) & (r[by] > 0)), lambda r: F.struct(r[by].alias("k"), r["at"].alias("at"), F.initcap(r["name"]).alias("name"), (r["area"] if by == "area" else F.lit(None).cast("double")).alias("area"), r["value"].alias("value"))))
        best = F.coalesce(top("area"), top("value"))
    crop = F.col(source.crop) if source.crop else best["name"]
    value = F.col(source.yields) if source.yields else best["value"]
    own = [(c, F.col(f"`{c}`")) for c in columns]
    if source.features:
        own = [(c, F.col(f"`{c}`")) for c in source.features if c in columns]
    elif best is not None:
        own = [("crop", best["name"]), ("yield", best["value"]), ("area", best["area"]), ("district", F.col(district)), ("year", F.col(year))]
    fields = F.create_map(*(x for name, c in own for x in (F.lit(name), text(c))))
    return F.struct(text(crop).alias("crop"), as_double(value).alias("yield_value"), fields.alias("fields"))


def tabular_features(probes: DataFrame, sources: list[Tabular], key: str, levels: Sequence[str], year: str, season: str, position: str, plain: Callable[[Column], Column] | None = normal_name) -> DataFrame:
    """(probe columns, level, source, crop, yield_value, fields): crop, yield and features of the row that tabular_match finds.

    Seasons of the tables hold those of the probes. Nothing found gives nulls.
    """
    tables = [s.frame.select(position, *levels, year, season, tabular_record(s, levels[-1], year).alias("_record")) for s in sources]
    found = tabular_match(probes, tables, key, levels, [year, season], position, ["_record"], holds=season, plain=plain)
    return found.select("*", "_record.*").drop("_record")


@dataclass(frozen=True)
class Years:
    """A table with a column of places and, if it has one, of years."""

    frame: DataFrame
    place: str
    year: str | None
    position: str


def first_table_years(labels: DataFrame, tables: list[Years], label: str, carry: list[str]) -> DataFrame:
    """(label, source, year, carried columns): the first table that knows the place, and its first row of each year.

    Places are equal but for case and outer blanks. Years that can't be read
    don't count, and a table without any other gives way to the next; one without
    a column of years answers with its first row, as year 0. All rows of the tables count.
    """
    wanted = labels.select(label, F.lower(F.trim(label)).alias("_at")).where("_at IS NOT NULL").distinct()
    found = []
    for i, t in enumerate(tables):
        year = as_year(F.col(t.year)) if t.year else F.lit(0)
        rows = t.frame.select(F.lower(F.trim(t.place)).alias("_at"), year.cast("int").alias("year"), F.col(t.position).cast("long").alias("_pos"), F.struct(*carry).alias("_row"))
        found.append(rows.where("_at IS NOT NULL AND year IS NOT NULL").groupBy("_at", "year").agg(F.min_by("_row", "_pos").alias("_row")).withColumn("source", F.lit(i)))
    # One row for each place and year of a table is left; the years of a place are few.
    every = reduce(DataFrame.unionByName, found).join(wanted.select("_at").distinct(), "_at", "left_semi")
    first = every.withColumn("_first", F.min("source").over(Window.partitionBy("_at"))).where("source = _first")
    return wanted.join(first, "_at").select(label, "source", "year", *(F.col(f"_row.{c}").alias(c) for c in carry))


def settled(probes: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, label, lon, lat, way): where a probe (key, village, district, lon, lat) is.

    The village's name counts, else the district's: the first place of that name,
    or else of one that begins so, those of its kind before others. Where there is none, the
    probe keeps its own coordinates; a district without coordinates keeps its
    name; without any name, coordinates stand for it. ``way`` is place, given,
    name, coordinates, or null where nothing settles it. Places have
    place_name, place_kind, place_lon, place_lat; the first is the least in
    (name, longitude, latitude).
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    label = F.coalesce(blank("village"), blank("district"))
    asked = probes.select(key, label.alias("name"), F.when(blank("village").isNotNull(), "village").otherwise("district").alias("kind"), (blank("district").isNotNull()).alias("_district"), "lon", "lat")
    near = F.struct("strategy", (~F.col("kind").eqNullSafe(F.col("place_kind"))).cast("int").alias("other"), "place_name", "place_lon", "place_lat")
    known = by_name(asked.select(key, "name", "kind"), places.select("place_name", "place_kind", "place_lon", "place_lat"), "name", "place_name").groupBy(key).agg(F.min(near).alias("_n"))
    both = asked.join(known, key, "left")
    own = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    way = F.when(F.col("_n").isNotNull(), "place").when(F.col("name").isNotNull() & own, "given").when(F.col("name").isNotNull() & F.col("_district"), "name").when(F.col("name").isNull() & own, "coordinates")
    shown = F.when(way == "place", F.col("_n.place_name")).when(way == "coordinates", F.concat_ws(", ", F.col("lat").cast("string"), F.col("lon").cast("string"))).when(way.isNotNull(), F.col("name"))
    spot = lambda c: F.when(way == "place", F.col(f"_n.place_{c}")).when(way.isin("given", "coordinates"), F.col(c)).alias(c)
    return both.select(key, shown.alias("label"), spot("lon"), spot("lat"), way.alias("way"))


def yearly(tabular: DataFrame, records: DataFrame, keys: list[str], position: str, values: list[str], order: list[str]) -> DataFrame:
    """(keys, first, records): the first tabular row of each key and year, and the list of records in order; either may be missing."""
    first = tabular.groupBy(*keys).agg(F.min_by(F.struct(*values), position).alias("first"))
    kept = [*order, *(c for c in records.columns if c not in (*keys, *order))]
    lists = records.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("records"))
    return first.join(lists, keys, "full_outer")


def temporal(asked: DataFrame, season: str, year: str, day: str, latest: str, default_season: str, default_year: int) -> DataFrame:
    """``asked`` with season and year as given, else those of the reference day, else the latest year and the defaults."""
    from agrarium.functions.seasons import season_of

    own = season_of(F.col(day))
    return asked.withColumns({season: F.coalesce(season, own["season"], F.lit(default_season)), year: F.coalesce(year, own["year"], latest, F.lit(default_year)).cast("int")})


def observations(places: DataFrame, key: str, ndvi: DataFrame, evi: DataFrame, record: str, compared: list[str], boxes: DataFrame, tables: list[DataFrame], carry: list[str]) -> DataFrame:
    """One row for each place, year and season: boundary, tabular row, image pairs, issues, quality score and acceptance.

    ``places`` (key, village, taluk, district, lon, lat); ``ndvi`` and ``evi``
    (key, season, year, day, record, compared) are paired by day, the first
    record of each; the years and seasons are those of the records. ``boxes``
    are those of smallest_boxes (levels taluk and district), ``tables`` those
    of tabular_match, matched once for each distinct set of names, year and
    season, however many places share it.
    """
    from agrarium.operators import filters

    cell = [key, "season", "year"]
    pairs = joins.outer_pairs(ndvi, evi, [*cell, "day"], record, [record, *compared])
    differ = reduce(Column.__or__, (F.col(f"left_{c}") != F.col(f"right_{c}") for c in compared))
    paired = F.col(f"left_{record}").isNotNull() & F.col(f"right_{record}").isNotNull()
    images = pairs.groupBy(*cell).agg(F.count("*").alias("n_dates"), F.count_if(paired).alias("n_pairs"), F.count_if(paired & differ).alias("n_mismatched"), F.min("day").alias("first_day"))
    every = ndvi.select("season", "year").unionByName(evi.select("season", "year")).distinct()
    # Years and seasons are few.
    cells = places.crossJoin(F.broadcast(every.select("year").distinct())).crossJoin(F.broadcast(every.select("season").distinct()))
    names = ["village", "taluk", "district"]
    asked = cells.select(*names, "year", "season").distinct().withColumn("_q", F.xxhash64(*names, "year", "season"))
    matched = saved(tabular_match(asked, tables, "_q", names, ["year", "season"], "pos", carry).select(*names, "year", "season", F.col("level").alias("tab_level"), *carry))
    bounds = spatial.smallest_boxes(places, boxes, key, "level", "name", ["taluk", "district"]).select(key, F.col("deepest").alias("boundary"))
    rows = cells.join(matched, [*names, "year", "season"], "left").join(bounds, key, "left").join(images, cell, "left").na.fill(0, ["n_dates", "n_pairs", "n_mismatched"])
    found = {
        "no_images": (F.col("n_dates") == 0, "error"), "unpaired": (F.col("n_dates") > F.col("n_pairs"), "warning"), "mismatched": (F.col("n_mismatched") > 0, "warning"),
        "no_tabular": (F.col("tab_level").isNull(), "error"), "fallback": (F.col("tab_level") == "none", "warning"), "no_boundary": (F.col("boundary").isNull(), "info"),
    }
    issues = F.array_compact(F.array(*(F.when(rule, name) for name, (rule, _) in found.items())))
    severities = F.array_compact(F.array(*(F.when(rule, severity) for rule, severity in found.values())))
    accepted = ~F.exists(severities, lambda s: s.isin("critical", "error"))
    return rows.select(key, "year", "season", "boundary", "tab_level", *carry, "n_dates", "n_pairs", "n_mismatched", "first_day", F.array_join(issues, ",").alias("issues"), filters.quality_score(severities).cast("int").alias("quality"), accepted.alias("accepted"))
