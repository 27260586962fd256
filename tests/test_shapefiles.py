"""Shapefiles written, read in parts, and with what other programs put in them."""

import struct

import pytest
from pyspark.sql import functions as F

from agrarium.sources import boundaries, shapefiles

SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]


@pytest.fixture
def folder(spark, tmp_path):
    shapefiles.register(spark)
    rows = [([[[x + i, y] for x, y in SQUARE], [[x + i, y] for x, y in HOLE]], {"name": f"Zoné {i}", "kind": None if i % 2 else "a"}) for i in range(40)] + [(None, {"name": "nothing"})]
    df = spark.createDataFrame(rows, shapefiles.SCHEMA.replace("record int, ", "")).repartition(3, "properties.name")
    df.write.format("shapefile").mode("append").save(str(tmp_path / "s"))
    return tmp_path / "s", rows


def test_round_trip(spark, folder):
    path, rows = folder
    assert len(list(path.glob("*.shp"))) <= 3 and not list(path.glob(".staged*"))
    back = spark.read.format("shapefile").load(str(path))
    found = {r["properties"]["name"]: (r["rings"], r["properties"]["kind"]) for r in back.collect()}
    assert found == {p["name"]: (rings, p.get("kind")) for rings, p in rows}


def test_parts_hold_all_records(spark, folder):
    path, rows = folder
    parts = shapefiles.ShapefileReader(str(path), 500).partitions()
    assert len(parts) > len(list(path.glob("*.shp"))) + 3
    whole = spark.read.format("shapefile").load(str(path))
    cut = spark.read.format("shapefile").option("partBytes", "500").load(str(path))
    assert cut.rdd.getNumPartitions() == len(parts)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(cut) == key(whole) and cut.count() == len(rows)


def test_as_boundaries(spark, folder):
    path, _ = folder
    found = boundaries.shapefile(spark, str(path), "block")
    assert found.count() == 40
    r = found.where(F.col("name") == "Zoné 3").first()
    assert (r["min_lon"], r["max_lon"], r["min_lat"], r["max_lat"], len(r["rings"])) == (3.0, 7.0, 0.0, 4.0, 2)


def test_other_writers(spark, tmp_path):
    """Polygons with heights, points, a deleted record, a table of another encoding, a file without a table."""
    shapefiles.register(spark)
    ring = b"".join(struct.pack("<dd", *p) for p in SQUARE)
    polygon = lambda kind, more: struct.pack("<i4dii", kind, 0, 0, 4, 4, 1, 5) + struct.pack("<i", 0) + ring + more
    shapes = [polygon(15, struct.pack("<7d", 0, 1, 0, 0, 0, 0, 1)), struct.pack("<idd", 1, 5, 6), polygon(5, b"")]
    body, index, at = b"", b"", 100
    for i, s in enumerate(shapes):
        index += struct.pack(">ii", at // 2, len(s) // 2)
        body += struct.pack(">ii", i + 1, len(s) // 2) + s
        at += 8 + len(s)
    for name in ("a", "bare"):
        (tmp_path / f"{name}.shp").write_bytes(bytes(100) + body)
        (tmp_path / f"{name}.shx").write_bytes(bytes(100) + index)
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6, 0]) + bytes(14)
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 100, 1, 1, 3, 65, 7) + field + b"\r" + " Zon\xe9  ".encode("latin-1") + b" point  "[:7] + b"*gone  "[:7] + b"\x1a")
    (tmp_path / "a.cpg").write_text("ISO-8859-1")
    found = spark.read.format("shapefile").load(str(tmp_path / "a.shp")).orderBy("record").collect()
    assert [(r["record"], r["properties"]["NAME"]) for r in found] == [(0, "Zoné"), (1, "point")]
    assert found[0]["rings"] == [SQUARE] and found[1]["rings"] is None
    bare = spark.read.format("shapefile").load(str(tmp_path / "bare.shp")).orderBy("record").collect()
    assert [r["properties"] for r in bare] == [{}, {}, {}] and bare[2]["rings"] == [SQUARE]


def test_what_cannot_be(spark, tmp_path):
    shapefiles.register(spark)
    df = spark.createDataFrame([([SQUARE], {"name": "x" * 255})], "rings array<array<array<double>>>, properties map<string,string>")
    with pytest.raises(Exception, match="254"):
        df.write.format("shapefile").mode("append").save(str(tmp_path / "s"))
    assert not list(tmp_path.rglob("*.shp"))
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("shapefile").load(str(tmp_path / "nowhere.shp")).collect()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("shapefile").load(str(tmp_path / "empty")).count() == 0
