"""Folders on disk: what is read again, encodings, checksums and damaged packages."""

import hashlib
import os

import pytest

from agrarium.sources import packages


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "data"
    (root / "NDVI" / "R10m").mkdir(parents=True)
    (root / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (root / "b.csv").write_bytes("naïve,\"z w\"\r\n1,2".encode("latin-1"))
    (root / "empty.csv").write_text("")
    (root / "notes.md").write_text("no data")
    (root / "NDVI" / "R10m" / "S2_2021-05-03.tif").write_bytes(b"II*\0rest")
    return root


def state(store):
    return {r.relative: r for r in store.read().collect()}


def test_only_changed_files_are_read(spark, folder, tmp_path, monkeypatch):
    store = packages.metadata_store(spark, str(tmp_path / "index"), 4)
    read = []
    real = packages.contents
    monkeypatch.setattr(packages, "contents", lambda s, paths, root: read.append([p.rsplit("/", 1)[1] for p in paths]) or real(s, paths, root))
    assert {(r.relative, r.status) for r in packages.index(spark, str(folder), store).collect()} == {("a.csv", "new"), ("b.csv", "new"), ("empty.csv", "new"), ("NDVI/R10m/S2_2021-05-03.tif", "new")}
    held = state(store)
    assert (held["a.csv"].row_count, held["a.csv"].columns, held["a.csv"].encoding) == (2, ["x", "y"], "UTF-8")
    assert (held["b.csv"].row_count, held["b.csv"].columns, held["b.csv"].encoding) == (1, ["naïve", "z w"], "ISO-8859-1")
    assert (held["empty.csv"].row_count, held["empty.csv"].column_count) == (0, 0)
    image = held["NDVI/R10m/S2_2021-05-03.tif"]
    assert (image.category, image.index_type, image.resolution, image.year, image.row_count) == ("GEOTIFF", "NDVI", "R10m", 2021, None)
    assert all(r.sha256 == hashlib.sha256((folder / k).read_bytes()).hexdigest() for k, r in held.items())
    version = store.manifest()["version"]
    packages.index(spark, str(folder), store)
    assert store.manifest()["version"] == version and len(read) == 1
    (folder / "a.csv").write_text("x,y\n1,2\n3,5\n")
    os.utime(folder / "a.csv", (1, 1))
    (folder / "b.csv").unlink()
    assert {r.relative: r.status for r in packages.index(spark, str(folder), store).collect()} == {"a.csv": "changed", "b.csv": "deleted", "empty.csv": "same", "NDVI/R10m/S2_2021-05-03.tif": "same"}
    assert read[1:] == [["a.csv"]] and set(state(store)) == {"a.csv", "empty.csv", "NDVI/R10m/S2_2021-05-03.tif"}
    packages.index(spark, str(folder), store, force=True)
    assert len(read[-1]) == 3


def test_damaged_packages_raise(spark, folder):
    manifest = spark.createDataFrame(packages.manifest_of(spark, str(folder)).collect())
    assert packages.load_release(spark, str(folder), manifest, "a.csv").count() == 2
    (folder / "notes.md").write_text("other")
    (folder / "new.txt").write_text("n")
    (folder / "empty.csv").unlink()
    assert {r.path: r.status for r in packages.verified(spark, str(folder), manifest).collect()} == {"a.csv": "ok", "b.csv": "ok", "notes.md": "changed", "new.txt": "extra", "empty.csv": "missing", "NDVI/R10m/S2_2021-05-03.tif": "ok"}
    with pytest.raises(ValueError, match="damaged"):
        packages.load_release(spark, str(folder), manifest, "a.csv")


def test_missing_folder(spark, tmp_path):
    assert packages.listed(spark, str(tmp_path / "none")).count() == 0
