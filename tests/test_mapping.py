"""Projections there and back, holes, resized patches against NumPy, and calendars of other forms."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrarium.functions import arrays, projection, seasons
from agrarium.operators import spatial
from agrarium.sources import boundaries


def test_known_points_and_round_trips(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 2_000), rng.uniform(-84, 84, 2_000)))] + [(-1, 3.0, 0.0), (-2, 74.856, 12.914), (-3, 9.0, 45.0), (-4, 180.0, -84.0), (-5, -180.0, 84.0)]
    df = spark.createDataFrame(rows, "i int, lon double, lat double").withColumn("epsg", projection.utm_epsg(F.col("lon"), F.col("lat")))
    df = df.withColumn("m", projection.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))).withColumn("g", projection.to_4326(F.col("m.x"), F.col("m.y"), F.col("epsg")))
    df = df.withColumn("w", projection.to_4326(projection.to_web(F.col("lon"), F.col("lat"))["x"], projection.to_web(F.col("lon"), F.col("lat"))["y"], F.lit(3857)))
    got = df.collect()
    assert all(abs(r.g.lon - r.lon) < 1e-8 and abs(r.g.lat - r.lat) < 1e-8 and abs(r.w.lon - r.lon) < 1e-8 and abs(r.w.lat - r.lat) < 1e-8 for r in got)
    by = {r.i: r for r in got}
    assert (by[-1].epsg, by[-1].m.x, by[-1].m.y) == (32631, pytest.approx(500_000, abs=1e-6), pytest.approx(0, abs=1e-6))
    assert (by[-3].epsg, by[-3].m.x, by[-3].m.y) == (32632, pytest.approx(500_000, abs=1e-6), pytest.approx(4_982_950.400, abs=0.001))
    # Along the equator the series begins as scale times the arc.
    assert by[-2].epsg == 32643 and abs(by[-2].m.x - 484_376) < 50 and abs(by[-2].m.y - 1_427_671) < 200
    odd = spark.createDataFrame([(1.0, 2.0, 4326), (1.0, None, 4326), (1.0, 2.0, 9999), (1.0, 2.0, 32661)], "x double, y double, e int").select(projection.to_4326(F.col("x"), F.col("y"), F.col("e")).alias("g")).collect()
    assert [r.g and tuple(r.g) for r in odd] == [(1.0, 2.0), None, None, None]


def square(a, b):
    return [[a, a], [b, a], [b, b], [a, b], [a, a]]


def test_holes_and_islands(spark, tmp_path):
    shapes = [("one", "Polygon", [square(0, 10), square(2, 8)]), ("many", "MultiPolygon", [[square(20, 30), square(22, 28)], [square(24, 26)]]), ("open", "Polygon", [square(40, 50)[:-1]]), ("point", "Point", [1, 1])]
    found = [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": t, "coordinates": c}} for n, t, c in shapes]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": found}))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, found)))
    points = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 21.0), (4, 23.0), (5, 25.0), (6, 45.0), (7, 2.0), (8, 55.0)], "i int, lon double").withColumn("lat", F.col("lon"))
    for path, lines in (("a.geojson", False), ("b.jsonl", True)):
        rings = boundaries.features(spark, str(tmp_path / path), "x", lines=lines)
        hits = {(r.i, r.name) for r in spatial.containing(points, rings, rings="rings").collect()}
        assert hits == {(1, "one"), (3, "many"), (5, "many"), (6, "open"), (7, "one")}
    metres = [{"type": "Feature", "properties": {"name": "utm"}, "geometry": {"type": "Polygon", "coordinates": [[[500_000, 0], [600_000, 0], [600_000, 100_000], [500_000, 100_000], [500_000, 0]]]}}]
    (tmp_path / "c.jsonl").write_text(json.dumps(metres[0]))
    r = boundaries.features(spark, str(tmp_path / "c.jsonl"), "x", epsg=32631, lines=True).first()
    assert (r.min_lon, r.min_lat) == (pytest.approx(3.0), pytest.approx(0.0)) and 3.8 < r.max_lon < 4.0 and 0.85 < r.max_lat < 0.95


def bilinear(a, h, w):
    def axis(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = at.astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    (r0, r1, rf), (c0, c1, cf) = axis(a.shape[0], h), axis(a.shape[1], w)
    wide = a[:, c0] * (1 - cf) + a[:, c1] * cf
    return wide[r0] * (1 - rf)[:, None] + wide[r1] * rf[:, None]


def test_resize_equals_numpy(spark):
    rng = np.random.default_rng(2)
    for (h, w), (p, q) in (((3, 4), (6, 8)), ((5, 7), (2, 3)), ((1, 1), (3, 2)), ((4, 4), (4, 4)), ((2, 5), (7, 1))):
        a = rng.normal(size=(h, w))
        r = spark.createDataFrame([(a.ravel().tolist(),), ([1.0],) if h * w > 1 else ([],), (None,)], "v array<double>").select(arrays.resized(F.col("v"), (h, w), (p, q)).alias("r")).collect()
        assert np.allclose(np.array(r[0].r).reshape(p, q), bilinear(a, p, q)) and r[1].r is None and r[2].r is None
    with pytest.raises(ValueError):
        arrays.resized(F.col("v"), (0, 3), (1, 1))


def test_calendars(spark, tmp_path):
    one = {"seasons": [{"name": "All", "start_month": 1, "end_month": 12}]}
    (tmp_path / "one.json").write_text(json.dumps(one))
    whole = seasons.load(spark, str(tmp_path / "one.json"))
    assert seasons.coverage(spark, whole).count() == 0 and seasons.coverage(spark, seasons.SEASONS).count() == 0
    assert seasons.load(spark, str(tmp_path / "none.json")) == seasons.SEASONS
    days = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2023, 12, 31),), (dt.date(2024, 4, 1),), (None,)], "d date")
    usual = {r.d: (r.season, r.season_year) for r in seasons.with_season(days, "d", seasons.SEASONS).collect()}
    assert usual == {r.d: (r.s and r.s.season, r.s and r.s.year) for r in days.select("d", seasons.season_of(F.col("d")).alias("s")).collect()}
    assert {r.season for r in seasons.with_season(days, "d", whole).collect()} == {"All", None}
    short = seasons.parsed(json.dumps({"seasons": [{"name": "A", "start_month": 2, "end_month": 2, "end_day": 31}, {"name": "B", "start_month": 2, "start_day": 20, "end_month": 3, "end_day": 1}]}))
    assert short[0].end_day == 29 and seasons.coverage(spark, short).where("issue = 'overlap'").count() == 10
    assert seasons.version(short) != seasons.version(whole) == seasons.version(seasons.parsed(json.dumps(one)))
    bad = ["[1]", "{}", '{"seasons": []}', '{"seasons": [1]}', '{"seasons": [{"name": "A", "start_month": 13, "end_month": 1}]}', '{"seasons": [{"name": "A", "start_month": "1", "end_month": 1}]}', '{"seasons": [{"name": "A", "start_month": 1, "end_month": 1, "colour": 1}]}', json.dumps({"seasons": one["seasons"] * 2}), '{"seasons": [', ""]
    for text in bad:
        with pytest.raises(seasons.CalendarError):
            seasons.parsed(text)


def test_wide_boxes_have_few_cells(spark):
    boxes = [(n, x, x + w, y, y + h) for n, x, w, y, h in [("world", -180.0, 360.0, -90.0, 180.0), ("dot", 3.0, 0.0, 4.0, 0.0), ("strip", -170.0, 340.0, 3.5, 1.0), ("cell", 3.0, 1.0, 4.0, 1.0), ("turned", 5.0, -1.0, 4.0, 1.0)]]
    shapes = spark.createDataFrame([(*b, [[b[1], b[3]], [b[2], b[3]], [b[2], b[4]], [b[1], b[4]]]) for b in boxes], "name string, min_lon double, max_lon double, min_lat double, max_lat double, ring array<array<double>>")
    points = [(i, float(i % 37 * 10 - 180), float(i % 19 * 10 - 90)) for i in range(300)] + [(300, 3.0, 4.0), (301, None, 4.0), (302, 3.5, 4.5), (303, 4.0, 5.0)]
    asked = spark.createDataFrame(points, "i long, lon double, lat double")
    found = spatial._in_boxes(asked, shapes, "lon", "lat", 1.0)
    want = {(i, n) for i, lon, lat in points for n, a, b, c, d in boxes if lon is not None and a <= lon <= b and c <= lat <= d}
    got = [(r.i, r.name) for r in found.select("i", "name").collect()]
    assert len(got) == len(want) and set(got) == want
    assert spatial._in_boxes(asked, shapes.limit(0), "lon", "lat", 1.0).count() == 0


def test_rings_decide_once_for_alike_spots_and_shapes(spark, monkeypatch):
    """Copies of points and shapes are all in the result, but rings are asked once for each distinct spot and shape."""
    points = spark.range(600).select("id", (F.col("id") % 3).cast("double").alias("lon"), F.lit(0.5).alias("lat"))
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-0.5, 0.0), (1.5, 0.0), (1.5, 1.0), (-0.5, 1.0), (-0.5, 0.0))))
    box = {"min_lon": F.lit(-0.5), "max_lon": F.lit(1.5), "min_lat": F.lit(0.0), "max_lat": F.lit(1.0)}
    shapes = spark.range(50).select(F.col("id").alias("name"), ring.alias("ring"), *(v.alias(k) for k, v in box.items()))
    seen, dealt = [], spatial._in_boxes
    monkeypatch.setattr(spatial, "_in_boxes", lambda p, s, *more: seen.append((p.count(), s.count())) or dealt(p, s, *more))
    found = spatial.containing(points, shapes)
    assert seen == [(3, 1)]
    assert found.count() == found.select("id", "name").distinct().count() == 400 * 50 and found.where("id % 3 = 2").isEmpty()
