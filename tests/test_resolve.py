"""Places and tabular rows by strategies in order."""

from pyspark.sql import functions as F

from agrarium.functions.names import normal_name
from agrarium.operators import joins, resolve
from agrarium.plans.catalog import QUERIES


def test_regex_stage(spark):
    table = spark.createDataFrame([(1, "Mysuru (Rural)"), (2, "mysore Town"), (3, "Hassan")], "pos int, name string")
    probes = spark.createDataFrame([("mys(ore|uru) t",), ("^has+an$",), ("Hassan",), ("(",), ("mys[",), ("none",), (None,)], "probe string")
    got = {r.probe: (r.matched, r.stage) for r in joins.staged_name_match(probes, table, "probe", "name", "pos").collect()}
    assert got == {"mys(ore|uru) t": ("mysore Town", 4), "^has+an$": ("Hassan", 4), "Hassan": ("Hassan", 1), "(": ("Mysuru (Rural)", 3)}


def test_located(spark):
    places = spark.createDataFrame([(1, "Alur", "district", 10.0, 10.0), (2, "alur", "village", 20.0, 20.0), (3, "Belur North", "village", 30.0, 30.0), (4, "Belur East", "village", 30.005, 30.0), (5, None, "village", -70.0, -30.0)], "p long, place_name string, place_kind string, place_lon double, place_lat double")
    probes = spark.createDataFrame([(1, " ALUR", "village", None, None), (2, "bel", "village", 0.0, 0.0), (3, "be", "district", None, None), (4, "unknown", "village", 30.001, 30.001), (5, None, "village", -100.0, -60.0), (6, "unknown", "village", None, None), (7, None, "village", 20.3, 20.3)], "id long, name string, kind string, lon double, lat double")
    rows = lambda **o: {(r.id, r["rank"]): (r.p, r.strategy) for r in resolve.located(probes, places, "id", "p", **o).collect()}
    box = rows()
    assert box == {(1, 1): (2, "name"), (1, 2): (1, "name"), (2, 1): (3, "prefix"), (2, 2): (4, "prefix"), (3, 1): (3, "prefix"), (3, 2): (4, "prefix"), (4, 1): (3, "box"), (4, 2): (4, "box"), (5, 1): (5, "nearest"), (6, None): (None, None), (7, 1): (2, "nearest")}
    wide = rows(km=60.0, k=2)
    assert wide[7, 1] == (2, "radius") and wide[4, 2] == (4, "radius") and (5, 2) in wide and wide[5, 1] == (5, "nearest")


def test_tabular_match(spark):
    schema = "pos long, village string, taluk string, district string, year int, season string, crop string"
    one = [(0, "Alur", "T1", "D1", 2001, "Rabi", "a"), (1, "Belur/Beluru", "T2", "D1", 2001, "Rabi", "b"), (2, "x", "T3", "Coorg", 2001, "Rabi", "c"), (3, "Alur", "T1", "D1", 2002, "Rabi", "d")]
    two = [(0, "Kodi", "T9", "D9", 2001, "Rabi", "e"), (1, "Kodi", "T9", "D9", 2003, "Rabi", "f")]
    asked = [(1, "Alur", None, None, 2001), (2, "Beluru", None, "D1", 2001), (3, "q", "T3", "D1", 2001), (4, "T3", "T3", None, 2001), (5, "q", "q", "coorg", 2001), (6, "kodi", None, None, 2001), (7, "q", None, None, 2001), (8, "q", None, None, 2003), (9, "Alur", None, None, 1999), (10, "Alur", None, None, 2002)]
    probes = spark.createDataFrame([(*r, "Rabi") for r in asked], "id long, village string, taluk string, district string, year int, season string")
    found = resolve.tabular_match(probes, [spark.createDataFrame(t, schema) for t in (one, two)], "id", ["village", "taluk", "district"], ["year", "season"], "pos", ["crop"])
    got = {r.id: (r.crop, r.level, r.source) for r in found.collect()}
    assert got == {1: ("a", "village", 0), 2: ("b", "village", 0), 3: ("c", "taluk", 0), 4: ("a", "none", 0), 5: ("c", "district", 0), 6: ("e", "village", 1), 7: ("a", "none", 0), 8: ("f", "none", 1), 9: (None, None, None), 10: ("d", "village", 0)}


def test_yearly(spark):
    tabular = spark.createDataFrame([("a", 2001, 5, "late"), ("a", 2001, 2, "first"), ("a", 2002, 1, "x")], "place string, year int, pos int, crop string")
    records = spark.createDataFrame([("a", 2001, "2001-05-02", 0.5), ("a", 2001, "2001-01-02", 0.4), ("b", 2003, "2003-01-01", 0.1)], "place string, year int, day string, ndvi double")
    got = {(r.place, r.year): (r.first and r.first.crop, r.records and [x.day for x in r.records]) for r in resolve.yearly(tabular, records, ["place", "year"], "pos", ["crop"], ["day"]).collect()}
    assert got == {("a", 2001): ("first", ["2001-01-02", "2001-05-02"]), ("a", 2002): ("x", None), ("b", 2003): (None, ["2003-01-01"])}


def test_observations_hold_all_orders(spark, sf):
    got = QUERIES["build_observations"](spark, sf).agg(F.sum("n_images"), F.count_distinct("season"), F.min("year"), F.max("year")).first()
    assert got[0] == spark.read.parquet(f"{sf}/orders.parquet").count() and got[1] == 3 and (got[2], got[3]) == (1994, 2001)


def test_seasons_held_and_plain_names(spark):
    schema = "pos long, village string, district string, year int, season string, crop string"
    rows = [(0, "Alur (East)", "Mangalore", 2001, "Rabi/Summer", "a"), (1, "alur", "Mangalore", 2001, "KHARIF 1", "b"), (2, "Kodi", "x", 2001, None, "c")]
    asked = [(1, "Alur", None, "rabi"), (2, "q", "Dakshina  Kannada (coast)", "Kharif"), (3, "Kodi", None, " "), (4, "Kodi", None, "Rabi"), (5, "al.r \\(", None, "summer"), (6, "(none)", None, "summer"), (7, "Alur", None, "Zaid")]
    probes = spark.createDataFrame([(i, v, d, 2001, s) for i, v, d, s in asked], "id long, village string, district string, year int, season string")
    found = resolve.tabular_match(probes, [spark.createDataFrame(rows, schema)], "id", ["village", "district"], ["year", "season"], "pos", ["crop"], holds="season", plain=lambda c: normal_name(c, {"dakshina kannada": "Mangalore"}))
    assert {r.id: (r.crop, r.level) for r in found.collect()} == {1: ("a", "village"), 2: ("b", "district"), 3: ("c", "village"), 4: ("a", "none"), 5: ("a", "village"), 6: ("a", "none"), 7: (None, None)}


def test_wide_records(spark):
    columns = ["pos", "v", "d", "y", "s", "RICE AREA (1000 ha)", "RICE YIELD (Kg per ha)", "FINGER MILLET AREA (1000 ha)", "Maize Yield (Kg per ha)", "note"]
    rows = [(0, "a", "D", 2001, "Rabi", 5.0, -1.0, 5.0, 9.0, "n"), (1, "b", "D", 2001, "Rabi", -1.0, 3.0, 0.0, 4.0, None), (2, "c", "D", 2001, "Rabi", -1.0, 0.0, 0.0, None, None), (3, "e", "D", 2001, "Rabi", 1.0, 7.0, 2.0, 9.0, "n")]
    frame = spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in zip(columns, ["long", "string", "string", "int", "string", "double", "double", "double", "double", "string"])))
    assert list(resolve.wide_crops(columns)) == ["RICE", "FINGER MILLET", "Maize"]
    got = [tuple(r.r) for r in frame.select(resolve.tabular_record(resolve.Tabular(frame), "d", "y").alias("r")).collect()]
    assert [g[:2] for g in got] == [("Rice", -1.0), ("Maize", 4.0), (None, None), ("Finger Millet", None)]
    assert got[1][2] == {"crop": "Maize", "yield": "4.0", "area": None, "district": "D", "year": "2001"} and got[0][2]["area"] == "5.0"
    named = frame.select(resolve.tabular_record(resolve.Tabular(frame, "note", "RICE YIELD (Kg per ha)".join("``"), ("s",)), "d", "y").alias("r")).first().r
    assert tuple(named) == ("n", -1.0, {"s": "Rabi"})


def test_first_table_and_settled(spark):
    one = spark.createDataFrame([("Alur ", "n/a", 1), (None, "2001", 2), ("Belur", "2002.0", 4), ("belur", "2002", 3), ("Belur", "soon", 0)], "place string, at string, k long")
    two = spark.createDataFrame([("alur", "1999", 7), ("ALUR", "1999", 6), ("Belur", "1990", 5)], "place string, at string, k long")
    three = spark.createDataFrame([("Coorg", 9), ("coorg", 8)], "place string, k long")
    tables = [resolve.Years(one, "place", "at", "k"), resolve.Years(two, "place", "at", "k"), resolve.Years(three, "place", None, "k")]
    labels = spark.createDataFrame([(" ALUR",), ("belur",), ("Coorg",), ("zz",), (None,)], "label string")
    got = sorted(tuple(r) for r in resolve.first_table_years(labels, tables, "label", ["k"]).collect())
    assert got == [(" ALUR", 1, 1999, 6), ("Coorg", 2, 0, 8), ("belur", 0, 2002, 3)]
    places = spark.createDataFrame([("Alur", "district", 1.0, 2.0), ("alur", "village", 3.0, 4.0), ("Belur North", "village", 5.0, 6.0)], "place_name string, place_kind string, place_lon double, place_lat double")
    asked = [(1, " ALUR", "x", 9.0, 9.0), (2, None, "alur", None, None), (3, "bel", None, None, None), (4, "zz", None, 7.0, 8.0), (5, "zz", "dd", None, 8.0), (6, "zz", None, None, None), (7, None, " ", 7.0, 8.0), (8, None, None, None, None)]
    probes = spark.createDataFrame(asked, "id long, village string, district string, lon double, lat double")
    got = {r.id: tuple(r)[1:] for r in resolve.settled(probes, places, "id").collect()}
    assert got == {1: ("alur", 3.0, 4.0, "place"), 2: ("Alur", 1.0, 2.0, "place"), 3: ("Belur North", 5.0, 6.0, "place"), 4: ("zz", 7.0, 8.0, "given"), 5: ("zz", None, None, "name"), 6: (None, None, None, None), 7: ("8.0, 7.0", 7.0, 8.0, "coordinates"), 8: (None, None, None, None)}


def test_names_are_looked_at_once(spark, monkeypatch):
    seen, staged = [], joins._staged

    def watched(probes, table, *rest):
        seen.append(table.count())
        return staged(probes, table, *rest)

    monkeypatch.setattr(joins, "_staged", watched)
    rows = [(500 - i, ("Alur", "Belur / x", "Hassan (Rural)")[i % 3], "T1", 2001) for i in range(300)]
    table = spark.createDataFrame(rows, "pos long, village string, taluk string, year int")
    probes = spark.createDataFrame([(1, "alur", "-", 2001), (2, "x", "-", 2001), (3, "has+an", "-", 2001), (4, "-", "T1", 2001), (5, "Alur", "-", 2001)], "id long, village string, taluk string, year int")
    found = resolve.tabular_match(probes, [table], "id", ["village", "taluk"], ["year"], "pos", ["pos"])
    first = [min(p for p, v, *_ in rows if v.startswith(n)) for n in ("Alur", "Belur", "Hassan")]
    assert {r.id: (r.pos, r.level) for r in found.collect()} == {1: (first[0], "village"), 2: (first[1], "village"), 3: (first[2], "village"), 4: (201, "taluk"), 5: (first[0], "village")}
    assert seen == [4]
