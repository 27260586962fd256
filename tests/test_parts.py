"""Operators, sources and streams on hand-made rows."""

import datetime as dt
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrarium.operators import drift, evaluation, filters, inference, joins, prepare, profile, sequences, spatial, splits, state, summaries
from agrarium.sources import boundaries, csvs, geotiff, inventory, sinks
from agrarium.streaming import requests


def test_chain_matches_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, v string")
    got = {tuple(r) for r in joins.chain(a, [(b, ["k"], "full_outer", "_b")]).collect()}
    assert got == {(1, "x", "p"), (None, "y", "q"), (3, None, "r")}


def test_nearest_date_ties_to_the_earlier(spark):
    left = spark.createDataFrame([(1, 7, "2020-01-10"), (2, 7, "2020-03-01"), (3, 8, "2020-01-01")], "id int, k int, d string").withColumn("d", F.to_date("d"))
    right = spark.createDataFrame([(7, "2020-01-08", "a"), (7, "2020-01-12", "b"), (7, None, "c")], "k int, on string, v string").withColumn("on", F.to_date("on"))
    got = {(r.id, r.v) for r in joins.nearest_date(left, right, "k", "d", "on", "id", ["v"]).collect()}
    assert got == {(1, "a"), (2, "b")}


def test_radius_wraps_and_reaches_poles(spark):
    rng = np.random.default_rng(1)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 150), rng.uniform(-90, 90, 150)))] + [(900, 179.9, 10.0), (901, 0.0, 89.9), (902, 100.0, -89.95)]
    b = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 150), rng.uniform(-90, 90, 150)))] + [(900, -179.9, 10.0), (901, 180.0, 89.9), (902, -80.0, -89.95)]

    def km(p, q):
        h = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    for radius in (50, 900):
        want = {(p[0], q[0]) for p in a for q in b if km(p, q) <= radius}
        found = spatial.within_radius(spark.createDataFrame(a, "i int, lon double, lat double"), spark.createDataFrame(b, "j int, place_lon double, place_lat double"), radius)
        got = [(r.i, r.j) for r in found.collect()]
        assert set(got) == want and len(got) == len(want)


def test_thinned_keeps_the_first(spark):
    rows = [(i, 74.8 + i * 0.0003, 13.1) for i in range(6)]
    kept = spatial.thinned(spark.createDataFrame(rows, "i int, lon double, lat double"), "i", 50.0)
    assert sorted(r.i for r in kept.collect()) == [0, 2, 4]


def test_levels(spark):
    hits = spark.createDataFrame([(1, "village", "A"), (1, "district", "DK"), (2, "district", "DK")], "p int, level string, name string")
    got = {r.p: r.deepest for r in spatial.levels_of(hits, "p", "level", "name", ["village", "taluk", "district"]).collect()}
    assert got == {1: "A", 2: "DK"}


def test_reference_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 2 + [(1,)] + [(2,)] * 5, "y int")
    got = {r.y: r.weight for r in summaries.class_weights(df, "y").collect()}
    assert got == pytest.approx({0: 15 / 17, 1: 30 / 17, 2: 6 / 17}, abs=1e-5)
    assert sum(r.weight for r in summaries.class_weights(df, "y", "sum_one").collect()) == pytest.approx(1, abs=1e-5)


def test_dominant_takes_first_of_equals(spark):
    df = spark.createDataFrame([(100.0, 50.0, 1.0, 2.0), (0.0, 0.0, 1.0, 2.0), (5.0, 5.0, 1.0, 9.0), (0.0, 0.0, 0.0, 0.0)], "ra double, ca double, rv double, cv double")
    got = [r[0] and r[0].name for r in df.select(summaries.dominant({"RICE": ("ra", "rv"), "COTTON": ("ca", "cv")})).collect()]
    assert got == ["RICE", "COTTON", "RICE", None]


def test_drift_of_equal_and_shifted(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=2000)
    a = spark.createDataFrame([(float(v),) for v in x], "x double")
    b = spark.createDataFrame([(float(v + 2),) for v in x], "x double")
    same = drift.divergences(drift.binned_shares(drift.both(a, a, "x"))).first()
    assert same.psi == pytest.approx(0, abs=1e-12)
    moved = drift.divergences(drift.binned_shares(drift.both(a, b, "x"))).withColumn("s", drift.severity(F.col("psi"), drift.PSI_LEVELS)).first()
    assert moved.s == "high"
    near = drift.ks_and_wasserstein(drift.both(a, b, "x")).first()
    pooled = np.sort(np.concatenate([x, x + 2]))
    cdf = lambda s: np.searchsorted(np.sort(s), pooled, side="right") / len(s)
    assert near.ks == pytest.approx(np.abs(cdf(x) - cdf(x + 2)).max()) and near.wasserstein == pytest.approx(2, abs=1e-9)
    assert drift.ks_p_value(near.ks, 2000, 2000) < 1e-6 and drift.ks_p_value(0.0, 10, 10) == 1.0
    assert drift.chi2_p_value(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert drift.chi2_p_value(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)


def test_yates(spark):
    a = spark.createDataFrame([("x",)] * 30 + [("y",)] * 10, "c string")
    b = spark.createDataFrame([("x",)] * 20 + [("y",)] * 20, "c string")
    r = drift.categorical_drift(drift.category_shares(a, b, "c")).first()
    assert (r.dof, r.chi2) == (1, pytest.approx(4.32))


def test_binary_rates(spark):
    y, p = [1, 1, 1, 1, 1, 1, 0, 0, 0, 0], [1, 1, 1, 1, 1, 0, 1, 0, 0, 0]
    r = evaluation.group_rates(spark.createDataFrame([("g", a, b) for a, b in zip(y, p)], "g string, y int, p int"), "g", "y", "p").first()
    assert (r.accuracy, round(r.tpr, 4), r.fpr, r.tnr, round(r.fnr, 4)) == (0.8, 0.8333, 0.25, 0.75, 0.1667)


def test_calibration_closes_the_last_bin(spark):
    df = spark.createDataFrame([(1.0, 1), (0.95, 1), (0.0, 0)], "p double, y int")
    got = {r.bin: r.n for r in evaluation.calibration(df, F.col("p"), F.col("y") == 1).collect()}
    assert got == {9: 2, 0: 1}


def test_losses(spark):
    p = F.array(F.lit(0.7), F.lit(0.2), F.lit(0.1))
    r = spark.range(1).select(evaluation.cross_entropy(p, F.lit(1)).alias("ce"), evaluation.cross_entropy(p, F.lit(1), 0.1).alias("smooth"), evaluation.focal_loss(p, F.lit(0)).alias("focal"), evaluation.huber(F.lit(3.0), F.lit(0.5)).alias("h")).first()
    assert r.ce == pytest.approx(-math.log(0.2)) and r.focal == pytest.approx(-(0.3**2) * math.log(0.7)) and r.h == 2.0
    assert r.smooth == pytest.approx(-(0.9 * math.log(0.2) + 0.1 / 3 * (math.log(0.7) + math.log(0.2) + math.log(0.1))))


def test_gate(spark):
    f = F.lit
    r = spark.range(1).select(drift.gate(f(0.85), f(0.8), f(12.0), f(10.0), f("low"), f("violating")).alias("bad"), drift.gate(f(0.85), f(None).cast("double"), f(12.0), f(None).cast("double"), f("low"), f("compliant")).alias("good")).first()
    assert (r.bad, r.good) == (["latency", "fairness"], [])


def test_pipeline_drops_and_encodes(spark):
    rows = [(i, float(i), 2.0 * i, 1.0, None if i == 3 else "ab"[i % 2]) for i in range(8)]
    df = spark.createDataFrame(rows, "i int, x double, x2 double, one double, c string")
    p = prepare.TabularPipeline(["x", "x2", "one"], ["c"], "i").fit(df)
    assert p.feature_names() == ["x", "c=a", "c=b", "c=__missing__"]
    out = {r.i: r.features for r in p.transform(df).collect()}
    assert out[3][1:] == [0, 0, 1] and sum(v[0] for v in out.values()) == pytest.approx(0, abs=1e-5)
    scale = prepare.min_max(df, ["x", "one"])
    back = df.withColumn("y", scale.of("x")).select(F.min("y"), F.max("y")).first()
    assert tuple(back) == (0.0, 1.0)
    inverse = scale.transform(df).select(scale.inverse("x").alias("x")).agg(F.max("x")).first()[0]
    assert inverse == 7.0


def test_folds_are_even_and_groups_whole(spark):
    df = spark.range(103).withColumn("g", F.col("id") % 10)
    sizes = [r["count"] for r in splits.folds(df, "id", 5).groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]
    assert splits.group_split(df, "g", 0.2, 0.1).groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    counts = {r.split: r["count"] for r in splits.random_split(df, "id", 0.2, 0.1).groupBy("split").count().collect()}
    assert counts == {"test": 21, "validation": 10, "train": 72}


def test_sequences_keep_the_tail(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", 1, 9.0)], "k string, t int, v double")
    got = {r.k: (list(r["values"]), r.mask) for r in sequences.sequences(df, "k", "t", "v", 3, keep_last=True, pad_left=True).collect()}
    assert got == {"a": ([2, 3, 4], [1, 1, 1]), "b": ([0, 0, 9], [0, 0, 1])}


def test_state(spark):
    reg = spark.createDataFrame([("m", 1, "production", dt.datetime(2020, 1, 1)), ("m", 2, "staging", None), ("n", 1, "production", None)], "name string, version int, stage string, promoted_at timestamp")
    got = {(r.name, r.version): r.stage for r in state.promoted(reg, "m", 2, "2021-01-01").collect()}
    assert got == {("m", 1): "archived", ("m", 2): "production", ("n", 1): "production"}
    table = spark.createDataFrame([("a", "1", "c", "d", 4)], "key string, value string, category string, description string, version int")
    got = {tuple(r) for r in state.setting(state.setting(table, "a", "2"), "b", "x", "cat").collect()}
    assert got == {("a", "2", "c", "d", 5), ("b", "x", "cat", None, 1)}
    rolled = state.rolled_back(state.versions(spark.createDataFrame([("a", 1), ("a", 2)], "k string, t int"), "k", ["t"]), "k", "a", 1)
    assert {(r.t, r.is_current) for r in rolled.collect()} == {(1, True), (2, False)}


def test_search_rejects_unknown(spark):
    with pytest.raises(ValueError):
        filters.search(spark.range(1), equal={"nope": 1})


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert [tuple(r) for r in profile.schema_issues(df).collect()] == [("warning", "mostly_missing", "b")]
    assert profile.schema_changes(df, df.withColumn("c", F.lit(1)).drop("a")) == {"added": ["c"], "removed": ["a"], "retyped": []}
    assert len(profile.schema_fingerprint(df)) == 64


def test_shapley_adds_up(spark):
    w = np.array([1.0, -2.0, 0.5])
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, x array<double>")
    got = inference.shapley(df, "id", "x", lambda x: x @ w, np.zeros(3)).first()
    assert list(got["values"]) == pytest.approx([1.0, -4.0, 1.5], abs=1e-6)


def test_csv_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/one.csv").write_bytes(b"\xef\xbb\xbfvillage,yield\nA,4500\nB,\nC,x\n")
    (tmp_path / "d/two.csv").write_bytes("a,b,c\né,1,2\n".encode("latin-1"))
    found = csvs.discover(spark, str(tmp_path))
    assert [r.name for r in found.collect()] == ["one", "two"] and csvs.tree_signature(found).first().files == 2
    assert csvs.encoding_of(spark, str(tmp_path / "d/one.csv")) == "UTF-8" and csvs.encoding_of(spark, str(tmp_path / "d/two.csv")) == "ISO-8859-1"
    df = csvs.scan(spark, str(tmp_path / "d/one.csv"), types={"yield": "double"})
    assert [tuple(r) for r in df.collect()] == [("A", 4500.0), ("B", None), ("C", None)]
    assert csvs.register(spark, str(tmp_path)) == ["one", "two"] and spark.table("two").columns == ["a", "b", "c"]
    assert csvs.inferred(["Dist Name", "Latitude", "lng", "Year"]) == {"lat": "Latitude", "lon": "lng", "name": "Dist Name", "year": "Year"}


def tiff(path, image, left=74.0, top=14.0, pixel=0.5):
    """A little-endian one-band float32 TIFF in one strip, EPSG 4326."""
    h, w = image.shape
    keys = (1, 1, 0, 1, 2048, 0, 1, 4326)
    tags = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (32,)), (259, 3, (1,)), (273, 4, (0,)), (277, 3, (1,)), (278, 4, (h,)), (279, 4, (h * w * 4,)), (339, 3, (3,)), (33550, 12, (pixel, pixel, 0.0)), (33922, 12, (0.0, 0.0, 0.0, left, top, 0.0)), (34735, 3, keys)]
    codes = {3: "H", 4: "I", 12: "d"}
    extra_at = 8 + 2 + 12 * len(tags) + 4
    body, extra = struct.pack("<H", len(tags)), b""
    data_at = extra_at + sum(struct.calcsize(f"<{len(v)}{codes[k]}") for _, k, v in tags if struct.calcsize(f"<{len(v)}{codes[k]}") > 4)
    for tag, kind, values in tags:
        values = (data_at,) if tag == 273 else values
        raw = struct.pack(f"<{len(values)}{codes[kind]}", *values)
        if len(raw) > 4:
            raw, extra = struct.pack("<I", extra_at + len(extra)), extra + raw
        body += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    path.write_bytes(b"II*\0" + struct.pack("<I", 8) + body + b"\0\0\0\0" + extra + image.astype("<f4").tobytes())


def test_rasters(spark, tmp_path):
    root = tmp_path / "NDVI" / "R10m"
    root.mkdir(parents=True)
    image = np.arange(12.0).reshape(3, 4)
    tiff(root / "a_2020-07-15.tif", image)
    (root / "broken_2019.tif").write_bytes(b"nothing")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in geotiff.metadata(files).collect()}
    a = rows["a_2020-07-15.tif"]
    assert (a.width, a.height, a.bands, a.dtype, a.crs, a.left, a.top, a.pixel_x, a.error) == (4, 3, 1, "float32", "EPSG:4326", 74.0, 14.0, 0.5, None)
    assert rows["broken_2019.tif"].error
    placed = files.where("path LIKE '%2020%'").withColumns({"lon": F.lit(74.1), "lat": F.lit(13.9)})
    p = geotiff.patches(placed, 3).first()
    assert p["values"] == [[0, 0, 0], [0, 0, 1], [0, 4, 5]] and p["mask"][1] == [False, True, True]
    found = {r.name: r for r in inventory.scan(spark, str(tmp_path), checksum=True).collect()}
    assert (found["a_2020-07-15.tif"].index_type, found["a_2020-07-15.tif"].resolution, found["a_2020-07-15.tif"].year, found["a_2020-07-15.tif"].date) == ("NDVI", "R10m", 2020, dt.date(2020, 7, 15))
    listing = inventory.scan(spark, str(tmp_path), checksum=True)
    assert inventory.counts(listing).first().geotiff == 2 and inventory.catalog(listing).count() == 2
    issues = {(r.code, r.what) for r in inventory.structure_issues(listing, ["NDVI", "EVI"], [2020, 2021]).collect()}
    assert issues == {("missing_index", "EVI"), ("missing_year", "2021")}
    manifest = listing.select("path", F.when(F.col("year") == 2020, F.col("sha256")).otherwise("0").alias("sha256"))
    assert sorted(r.status for r in inventory.verified(listing, manifest).collect()) == ["changed", "ok"]
    assert inventory.changed(listing, listing.select("path", "length")).count() == 0


def test_geojson(spark, tmp_path):
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}, {"type": "Feature", "properties": {"name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[5, 5], [6, 5], [6, 6], [5, 5]]], [[[8, 8], [9, 8], [9, 9], [8, 8]]]]}}]}
    (tmp_path / "b.geojson").write_text(json.dumps(shape))
    rings = boundaries.geojson(spark, str(tmp_path / "b.geojson"), "village")
    assert sorted(r.name for r in rings.collect()) == ["A", "B", "B"]
    c = boundaries.centroids(rings).where("name = 'A'").first()
    assert (c.lon, c.lat) == (1.0, 1.0)
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 8.9, 8.5), (3, 3.0, 3.0)], "i int, lon double, lat double")
    assert {(r.i, r.name) for r in spatial.containing(points, rings).collect()} == {(1, "A"), (2, "B")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1, 2], {"a": "b"})], "i int, x double, l array<int>, m map<string,string>")
    for kind in sinks.FORMATS:
        sinks.write(df, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 1 and "x" not in json.loads("".join(p.read_text() for p in (tmp_path / "jsonl").glob("*.json")))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().l == "[1,2]"
    assert spark.read.parquet(str(tmp_path / "parquet")).first().m == {"a": "b"}
    with pytest.raises(ValueError):
        sinks.write(df, str(tmp_path / "no"), "xls")
    sinks.append_log(df.select("i"), str(tmp_path / "log"))
    sinks.append_log(df.select("i"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).select("run_id").distinct().count() == 2


def test_stream_metrics(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = requests.metrics(stream, "ts", "event_type", "value", 50.0, late="60 days").writeStream.outputMode("complete").format("memory").queryName("metrics").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("metrics").agg(F.sum("requests"), F.sum("errors")).first()
    assert tuple(got) == tuple(rows.agg(F.count("*"), F.count_if(F.col("value") >= 50)).first())
