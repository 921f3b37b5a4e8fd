"""Writing results: tables, overlapping views, logs, small documents and reports."""

from __future__ import annotations

import hashlib
import html
import json
import os
import platform
import tempfile
from datetime import UTC, datetime

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reports are small documents made by the driver; longer tables belong in files.
REPORT_ROWS = 5000


def now_utc() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_json(path: str, content: dict) -> None:
    """A small JSON document, replaced as a whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(content, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)
            f.write("\n")
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a JSON log as its next batch, in the order of ``df``; files already there are never touched.

    Batches are numbered, so a reader knows their order whatever their sizes and times. Of two writers
    that take the same number at a time, one is refused.
    """
    spark = df.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    last = max([int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")], default=-1)
    df.write.mode("errorifexists").json(f"{path}/batch={last + 1:06d}")


def write_table(df: DataFrame, path: str, columns: list[str], kind: str = "csv") -> None:
    """The named columns in the given order; booleans as true and false, lists joined by bars."""
    known = dict(df.dtypes)
    out = []
    for c in columns:
        value = F.col(c) if c in known else F.lit(None).cast("string")
        if kind == "csv" and known.get(c, "").startswith("array"):
            value = F.array_join(value, "|")
        out.append(value.alias(c))
    writer = df.select(*out).write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True, escape='"', quote='"')
    else:
        writer.format(kind).save(path)


def write_views(df: DataFrame, folder: str, flags: dict[str, str]) -> None:
    """One table per view; a row goes into every view whose flag it has."""
    for view, flag in flags.items():
        df.where(F.col(flag) == 1).write.mode("overwrite").parquet(f"{folder}/{view}")


def provenance(spark: SparkSession, inputs: dict[str, DataFrame], sources: list[str] = ()) -> DataFrame:
    """(name, rows, columns, checksum) of each input and one row per source file digest.

    The checksum adds up row hashes, so it doesn't depend on their order.
    """
    rows = []
    for name, df in inputs.items():
        got = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))
        rows.append(got.select(F.lit(name).alias("name"), "rows", F.lit(",".join(df.columns)).alias("columns"), "checksum"))
    for path in sources:
        rows.append(spark.createDataFrame([(path, None, None, file_digest(path))], "name string, rows bigint, columns string, checksum string"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def input_ranges(inputs: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, column, first, last): the range of a column of each input, as text; nulls count for nothing."""
    out = None
    for name, (df, column) in inputs.items():
        got = df.agg(F.min(column).cast("string").alias("first"), F.max(column).cast("string").alias("last")).select(F.lit(name).alias("name"), F.lit(column).alias("column"), "first", "last")
        out = got if out is None else out.unionByName(got)
    return out


def versions() -> dict[str, str]:
    return {"python": platform.python_version(), "spark": pyspark.__version__, "made_at_utc": now_utc()}


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def source_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of all files below a path, hashed where they lie."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose content differs, or that came or went, between two listings of digests."""
    a, b = before.withColumnRenamed("sha256", "before"), after.withColumnRenamed("sha256", "after")
    return a.join(b, "path", "full").where(~F.col("before").eqNullSafe(F.col("after")))


def failure_document(path: str, stage: str, error: BaseException) -> None:
    """What went wrong, beside whatever was landed before."""
    write_json(path, {"status": "failed", "stage": stage, "error_kind": type(error).__name__, "message": str(error), "failed_at_utc": now_utc()})


def _cells(df: DataFrame, columns: list[str]) -> list[list[str]]:
    rows = df.select(*columns).limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report holds {REPORT_ROWS} rows at most; write a table instead")
    return [["" if v is None else str(v) for v in r] for r in rows]


def html_report(df: DataFrame, columns: list[str], title: str, link: str | None = None) -> str:
    """A table as HTML, everything escaped; only http and https addresses become links."""
    def cell(name: str, value: str) -> str:
        safe = html.escape(value)
        if name == link and value.lower().startswith(("http://", "https://")):
            return f'<td><a href="{safe}">{safe}</a></td>'
        return f"<td>{safe}</td>"

    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(map(cell, columns, row)) + "</tr>" for row in _cells(df, columns))
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>"


def markdown_report(df: DataFrame, columns: list[str], title: str) -> str:
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(columns), line(["---"] * len(columns)), *map(line, _cells(df, columns)), ""])


def chart_points(df: DataFrame, x: str, y: str, series: str) -> DataFrame:
    """Long rows (series, x, y) in plotting order, null points left out."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(series).alias("series"), F.col(x).alias("x"), F.col(y).alias("y")).orderBy("series", "x")
