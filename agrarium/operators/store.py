"""A keyed table on shared storage, with upserts, deletes, versions and rollback.

Rows lie in hash buckets of their key, a folder of Parquet each. A batch reads
and rewrites the buckets that it touches and no others, into a new folder; then
a manifest, which names the folder of every bucket, is put in place under the
next number. A manifest is complete or isn't there, and its number can be taken
once only, so that of two writers who began at the same version one fails and
nothing of its work is seen. Older manifests stay readable and can be made the
newest again; ``vacuum`` deletes what no kept manifest names.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer took the version."""


class _Files:
    """Small files and folders by Hadoop's file systems, so that any path will do that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a file under a name that no file has yet; it is there with all its text or not at all."""
        beside = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(beside)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(beside), self.fs.makeQualified(self.path(name)), self._no_options())
        except Py4JJavaError as e:
            self.fs.delete(beside, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(name) from None
            raise

    def _no_options(self) -> Any:
        from pyspark import SparkContext

        return SparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def status(self, name: str) -> Any:
        return self.fs.getFileStatus(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class KeyedStore:
    """A table of one row per key below ``root``.

    ``create`` starts one; ``KeyedStore(spark, root)`` opens it. Null is a key
    like any other. ``buckets`` should be such that a bucket, which one task
    rewrites, has some hundred megabytes.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._files = spark, root.rstrip("/"), _Files(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], buckets: int = 64) -> KeyedStore:
        if not keys or set(keys) - set(schema.names):
            raise ValueError("keys must be columns of the schema")
        store = cls(spark, root)
        store._commit({"version": 0, "action": "create", "keys": keys, "buckets": buckets, "schema": json.loads(schema.json()), "folders": {}, "rows": 0})
        return store

    # Manifests.

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def _commit(self, manifest: dict) -> None:
        self._files.put(self._name(manifest["version"]), json.dumps(manifest))

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._files.names(f"{self.root}/manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        held = self.numbers()
        if not held:
            raise ValueError(f"no store at {self.root}")
        if version is not None and version not in held:
            raise ValueError(f"no version {version}; there are {held[0]} to {held[-1]}")
        return json.loads(self._files.read(self._name(held[-1] if version is None else version)))

    def versions(self) -> DataFrame:
        """(version, action, rows, rewritten): one row for each manifest, with the number of buckets it put anew."""
        rows, before = [], {}
        for v in self.numbers():
            m = self.manifest(v)
            rows.append((v, m["action"], m["rows"], sum(before.get(b) != f for b, f in m["folders"].items())))
            before = m["folders"]
        return self.spark.createDataFrame(rows, "version long, action string, rows long, rewritten int")

    # Reading.

    def _of(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        folders = [f for b, f in m["folders"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the newest if none is given."""
        return self._of(self.manifest(version))

    def get(self, **key: Any) -> DataFrame:
        """The row of one key, from its bucket alone."""
        m = self.manifest()
        if set(key) != set(m["keys"]):
            raise ValueError(f"a key has {m['keys']}")
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(m["schema"])}
        values = [F.lit(key[k]).cast(kinds[k]) for k in m["keys"]]
        (bucket,) = self.spark.range(1).select(_bucket(values, m["buckets"])).first()
        return self._of(m, [bucket]).where(reduce(Column.__and__, (F.col(k).eqNullSafe(v) for k, v in zip(m["keys"], values, strict=True))))

    def query(self, **filters: Any) -> DataFrame:
        """Rows that equal the filters; None filters nothing. A filter must be a column."""
        df = self.read()
        if unknown := set(filters) - set(df.columns):
            raise ValueError(f"no such column: {sorted(unknown)}")
        for c, v in filters.items():
            if v is not None:
                df = df.where(F.col(c) == F.lit(v))
        return df

    def count(self) -> int:
        """Rows of the newest version, from its manifest."""
        return self.manifest()["rows"]

    # Writing.

    def upsert(self, batch: DataFrame, ingested: str | None = None) -> int:
        """Puts rows in place of those with equal keys, and returns the version.

        Of a key given twice the row with the greatest ``ingested`` counts (a
        column of the batch that isn't kept), or without it the greatest row;
        this is settled before the shuffle, so that a hot key is one row there.
        Columns that the batch lacks become null; unknown ones are an error.
        """
        m = self.manifest()
        schema = T.StructType.fromJson(m["schema"])
        if unknown := set(batch.columns) - set(schema.names) - {ingested}:
            raise ValueError(f"no such column: {sorted(unknown)}")
        if missing := set(m["keys"]) - set(batch.columns):
            raise ValueError(f"the batch lacks {sorted(missing)}")
        row = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in batch.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        pick = F.max_by(row, F.struct(F.col(ingested), row)) if ingested and ingested not in schema.names else F.max_by(row, F.col(ingested)) if ingested else F.max(row)
        new = batch.groupBy(*(F.col(k).cast(schema[k].dataType).alias(k) for k in m["keys"])).agg(pick.alias("_row")).select("_row.*")
        return self._rewrite(m, "upsert", new, F.lit(True))

    def delete(self, keys: DataFrame) -> int:
        """Takes out the rows of these keys, and returns the version."""
        m = self.manifest()
        schema = T.StructType.fromJson(m["schema"])
        distinct = keys.select(*(F.col(k).cast(schema[k].dataType).alias(k) for k in m["keys"])).distinct()
        gone = distinct.select(*(F.col(f.name) if f.name in m["keys"] else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        return self._rewrite(m, "delete", gone, F.lit(False))

    def delete_where(self, condition: str) -> int:
        """Takes out the rows that a condition holds for; only buckets that have such rows are rewritten."""
        return self.delete(self.read().where(condition))

    def rollback(self, version: int) -> int:
        """Makes an older version the newest, as a version of its own; no data is written."""
        old, m = self.manifest(version), self.manifest()
        self._commit(old | {"version": m["version"] + 1, "action": f"rollback {version}"})
        return m["version"] + 1

    def _rewrite(self, m: dict, action: str, new: DataFrame, stays: Column) -> int:
        keys, names, version = m["keys"], T.StructType.fromJson(m["schema"]).names, m["version"] + 1
        folder = f"data/{version:012d}-{uuid.uuid4().hex}"
        incoming = new.withColumns({"_bucket": _bucket([F.col(k) for k in keys], m["buckets"]), "_stays": stays, "_new": F.lit(True)})
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        incoming.write.parquet(staged)  # read twice below; the batch is computed once
        incoming = self.spark.read.schema(incoming.schema).parquet(staged)
        touched = sorted(r[0] for r in incoming.select("_bucket").distinct().collect())  # at most as many as there are buckets
        folders = {b: f for b, f in m["folders"].items() if int(b) not in touched}
        if touched:
            old = self._of(m, touched).withColumns({"_bucket": _bucket([F.col(k) for k in keys], m["buckets"]), "_stays": F.lit(True), "_new": F.lit(False)})
            # One shuffle: the buckets' rows meet, and the key's newest row is found where they are.
            place = F.row_number().over(Window.partitionBy("_bucket", *keys).orderBy(F.desc("_new")))
            both = old.unionByName(incoming).repartition("_bucket").withColumn("_place", place)
            kept = both.where((F.col("_place") == 1) & F.col("_stays")).select(*names, "_bucket")
            kept.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            folders |= {n.removeprefix("_bucket="): f"{folder}/{n}" for n in self._files.names(f"{self.root}/{folder}") if n.startswith("_bucket=")}
        self._files.delete(staged)
        # Counted by the Parquet footers of what was written and of what stays.
        rows = self._of(m | {"folders": folders}).count()
        self._commit(m | {"version": version, "action": action, "folders": folders, "rows": rows})
        return version

    # Upkeep.

    def export(self, path: str, kind: str = "parquet", version: int | None = None) -> None:
        """Writes a version as one table of another kind; nested columns become JSON where the kind has none."""
        df = self.read(version)
        if kind == "csv":
            nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
            df = df.withColumns({c: F.to_json(c) for c in nested})
        df.write.format(kind).option("header", "true").save(path)

    def vacuum(self, keep: int = 10) -> int:
        """Keeps the newest manifests and what they name, and deletes the rest; returns the number of folders deleted. Not to be run beside a writer."""
        numbers = self.numbers()
        kept = numbers[-max(1, keep) :]
        named = {f for v in kept for f in self.manifest(v)["folders"].values()}
        gone = 0
        for top in self._files.names(f"{self.root}/data"):
            for own in self._files.names(f"{self.root}/data/{top}"):
                if own.startswith("_bucket=") and f"data/{top}/{own}" not in named:
                    self._files.delete(f"{self.root}/data/{top}/{own}")
                    gone += 1
            if not any(f.startswith(f"data/{top}/") for f in named):
                self._files.delete(f"{self.root}/data/{top}")
        for v in numbers[: -len(kept)]:
            self._files.delete(self._name(v))
        return gone


def _bucket(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
