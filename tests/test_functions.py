"""Column functions on hand-made values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from agrarium.functions import arrays, geo, names, seasons


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_names(spark):
    s = F.lit
    r = one(
        spark,
        alias=names.normal_name(s("  Mangalore  (City) "), {"mangalore": "Dakshina Kannada"}),
        plain=names.normal_name(s("Bengaluru   (Urban)")),
        index=names.index_type_of(s("data/NDVI_2019/evi/a.tif")),
        no_index=names.index_type_of(s("data/a.tif")),
        res=names.resolution_of(s("x/r 20 m/a.tif")),
        year=names.year_of(s("a120199_2019_b")),
        no_year=names.year_of(s("120199")),
        date=names.date_of(s("x_2020_02_29.tif")),
        bad_date=names.date_of(s("x_2019-02-29.tif")),
        number=names.as_double(s(" 12.5 ")),
        text=names.as_double(s("12,5")),
        blank=names.as_double(s(" ")),
        nan=names.as_double(s("NaN")),
        as_year=names.as_year(s("2019.0")),
        version=names.version_key(s("1.12.3")),
        no_version=names.version_key(s("1.12")),
        minor=names.bumped(s("1.12.3"), "minor"),
        patch=names.bumped(s("1.12.3"), "patch"),
        size=names.readable_size(s(1536)),
        small=names.readable_size(s(12)),
        large=names.readable_size(s(3 * 1024**4)),
    )
    assert (r.alias, r.plain) == ("Dakshina Kannada", "Bengaluru")
    assert (r["index"], r.no_index, r.res) == ("EVI", None, "R20m")
    assert (r.year, r.no_year, r.date, r.bad_date) == (2019, None, dt.date(2020, 2, 29), None)
    assert (r.number, r.text, r.blank, r.nan, r.as_year) == (12.5, None, None, None, 2019)
    assert (r.version, r.no_version, r.minor, r.patch) == ([1, 12, 3], None, "1.13.0", "1.12.4")
    assert (r.size, r.small, r.large) == ("1.5 KB", "12 B", "3.0 TB")


def test_seasons(spark):
    days = ["2020-06-01", "2020-10-31", "2020-11-01", "2021-03-31", "2021-04-01", "2021-02-28"]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    got = [tuple(r.s) for r in df.select(seasons.season_of(F.to_date("d")).alias("s"), "d").collect()]
    assert got == [("Kharif", 2020), ("Kharif", 2020), ("Rabi", 2020), ("Rabi", 2020), ("Summer", 2021), ("Rabi", 2020)]
    w = {(r.season, r.year): (r.start, r.end) for r in seasons.windows(spark.range(2023, 2025).toDF("year"), seasons=(seasons.Season("Late", 11, 1, 2, 31),)).collect()}
    assert w[("Late", 2023)] == (dt.date(2023, 11, 1), dt.date(2024, 2, 29)) and w[("Late", 2024)][1] == dt.date(2025, 2, 28)
    assert seasons.months(seasons.SEASONS[1]) == [11, 12, 1, 2, 3]


def test_geo(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0))))
    inside = lambda x, y: geo.in_ring(F.lit(float(x)), F.lit(float(y)), ring)
    r = one(spark, km=geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), a=inside(1, 1), notch=inside(2, 2), edge=inside(4, 2), corner=inside(0, 0), out=inside(5, 1), ok=geo.valid_coordinates(F.lit(180), F.lit(-90)), bad=geo.valid_coordinates(F.lit(181), F.lit(0)), crs=geo.normal_crs(F.lit(" epsg: 4326")))
    assert r.km == pytest.approx(math.pi * geo.EARTH_KM / 180)
    assert (r.a, r.notch, r.edge, r.corner, r.out) == (True, False, True, True, False)
    assert (r.ok, r.bad, r.crs) == (True, False, "EPSG:4326")
    w = one(spark, **geo.clamped_window(F.lit(1), F.lit(9), 8, F.lit(10), F.lit(10)))
    assert w.asDict() == {"row_off": 0, "col_off": 5, "height": 5, "width": 5, "pad_top": 3, "pad_left": 0}


def test_arrays(spark):
    v = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    days = F.array(*(F.lit(d).cast("date") for d in ("2020-01-05", "2020-01-01", "2020-01-01", "2020-01-31")))
    r = one(spark, right=arrays.padded(v, 5), left=arrays.padded(v, 5, pad_left=True), cut=arrays.padded(v, 2), tail=arrays.padded(v, 2, keep_last=True), mask=arrays.pad_mask(v, 5), mask_left=arrays.pad_mask(v, 5, pad_left=True), gaps=arrays.day_gaps(days), p=arrays.softmax(v), bits=arrays.entropy(F.array(F.lit(0.5), F.lit(0.5))), top=arrays.top_classes(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)), 2))
    assert (r.right, r.left) == ([1, 2, 3, 0, 0], [0, 0, 1, 2, 3])
    assert (r.cut, r.tail, r.mask, r.mask_left) == ([1, 2], [2, 3], [1, 1, 1, 0, 0], [0, 0, 1, 1, 1])
    assert r.gaps == [4, 26] and sum(r.p) == pytest.approx(1) and r.bits == pytest.approx(1)
    assert [x.i for x in r.top] == [1, 2]
