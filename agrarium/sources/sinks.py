"""Writers: tables by format, line-wise logs, reports, versioned artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv", "orc": "orc"}


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as nulls, for formats that have none."""
    reals = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in reals})


def flat(df: DataFrame) -> DataFrame:
    """Maps, arrays and structs as JSON, for formats that hold none."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    return df.withColumns({c: F.to_json(c) for c in nested})


def write(df: DataFrame, path: str, kind: str, mode: str = "errorifexists", partition: tuple[str, ...] = ()) -> None:
    """``df`` in one of ``FORMATS``."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; known are {sorted(FORMATS)}")
    ready = flat(finite(df)) if kind == "csv" else finite(df) if kind in ("json", "jsonl") else df
    writer = ready.write.mode(mode).partitionBy(*partition) if partition else ready.write.mode(mode)
    (writer.option("header", "true") if kind == "csv" else writer).format(FORMATS[kind]).save(path)


def html(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report's rows as a table in one HTML file, in the order of their columns; for reports, since one task writes the file."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    cells = F.concat(*(F.concat(F.lit("<td>"), F.coalesce(plain(F.col(c).cast("string")), F.lit("")), F.lit("</td>")) for c in df.columns))
    lines = flat(df).select(F.lit(1).alias("at"), F.struct(*df.columns).alias("row"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("value"))
    head = "<!DOCTYPE html><table><tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
    ends = df.sparkSession.createDataFrame([(0, head), (2, "</table>")], "at int, value string")
    whole = lines.unionByName(ends, allowMissingColumns=True).coalesce(1).sortWithinPartitions("at", "row")
    whole.select("value").write.mode(mode).text(path)


def not_empty(df: DataFrame) -> DataFrame:
    """``df``, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError("there are no rows to export")
    return df


def append_log(df: DataFrame, path: str) -> None:
    """Run records as JSON lines with an id and a time."""
    df.withColumn("run_id", F.expr("uuid()")).withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def tensor_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One float vector of numeric and boolean columns, nulls as 0."""
    return df.withColumn("features", F.array(*(F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in columns)))


def comparison(df: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers as text with four decimals, for a comparison table."""
    reals = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in keys]
    return df.withColumns({c: F.format_string("%.4f", c) for c in reals})


def put_version(df: DataFrame, root: str, namespace: str, fingerprint: str, version: int) -> str:
    """An artefact at its namespace, fingerprint and version; another fingerprint is another place, so old ones never match."""
    path = f"{root}/{namespace}/fingerprint={fingerprint}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
