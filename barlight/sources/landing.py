"""Landed provider files: request logs, response envelopes, texts, and the plan of request windows."""

from __future__ import annotations

import importlib
import json
import time
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ARTICLE = "struct<category:string,datetime:bigint,headline:string,id:bigint,image:string,related:string,source:string,summary:string,url:string>"
ENVELOPE = f"schema_version int, request struct<endpoint:string,symbol:string,`from`:string,`to`:string>, retrieved_at_utc string, http_status int, response_headers map<string,string>, collection_status string, terminal_window boolean, response array<{ARTICLE}>"
MANIFEST = "record_type string, window_id string, ticker string, from_date date, to_date date, status string, http_status int, retrieved_at_utc string, article_count int, raw_file string, error_kind string, attempt int"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSONL files, blank lines skipped, with ``line_no``, by which lines are in order.

    Bad JSON raises. Where ``append_log`` wrote the files, its batches come first, then their parts;
    other files come by time of change and path. Within a file a line stands by its split's start
    and its row there. A scan packs splits by size, so the row alone tells nothing across splits.
    """
    lines = spark.read.text(path)
    file = F.col("_metadata.file_path")
    batch = F.col("batch").cast("bigint") if "batch" in lines.columns else F.lit(None).cast("bigint")
    part = F.regexp_extract(file, r"part-(\d+)[^/]*$", 1)
    place = F.struct(
        batch.alias("batch"), F.when(batch.isNull(), F.col("_metadata.file_modification_time")).alias("changed"),
        F.when(batch.isNotNull() & (part != ""), part.cast("bigint")).alias("part"), file.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_row").alias("row"),
    )
    lines = lines.select("value", F.monotonically_increasing_id().alias("_row"), *[c for c in lines.columns if c == "batch"], "_metadata").select("value", place.alias("line_no"))
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "line_no")
    return parsed.where(F.col("r").isNotNull()).select("r.*", "line_no")


def latest_requests(log: DataFrame) -> DataFrame:
    """The last row of each window of an append-only request log.

    The window function keeps one row per window before the shuffle already.
    """
    rows = log.where(F.col("record_type") == "request_window")
    order = Window.partitionBy("window_id").orderBy(F.desc("line_no"))
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 1).drop("_r")


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Response envelopes (one JSON document per file) with their file's path."""
    return spark.read.schema(ENVELOPE).json(path, multiLine=True, mode="FAILFAST", recursiveFileLookup=True).withColumn("raw_file", F.col("_metadata.file_path"))


def envelope_articles(envelopes: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """One row per article of finished successful envelopes, with its place in the list.

    Articles without a time are kept; others must lie between the dates (UTC, inclusive), if given.
    """
    done = envelopes.where(F.col("collection_status").startswith("success") & F.col("terminal_window") & F.col("response").isNotNull())
    rows = done.select(F.col("request.symbol").alias("queried_ticker"), "retrieved_at_utc", "raw_file", F.posexplode("response").alias("position", "a"))
    rows = rows.select("queried_ticker", "retrieved_at_utc", "raw_file", "position", "a.*").withColumn("published_at_utc", F.timestamp_seconds("datetime"))
    if first and last:
        rows = rows.where(F.col("published_at_utc").isNull() | F.to_date("published_at_utc").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows


def read_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, every column as text; quoted line breaks and doubled quotes allowed."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', quote='"', mode="FAILFAST", enforceSchema=False)


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """(raw_file, bytes) of all files below a path, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("raw_file"), F.col("length").alias("bytes"))


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return check_config(json.load(f))


def check_config(config: dict) -> dict:
    """The collection's settings, or an error that names the first bad one."""
    tickers = config["tickers"]
    for bad, what in (
        (date.fromisoformat(config["start_date"]) > date.fromisoformat(config["end_date"]), "start_date lies after end_date"),
        (not tickers or len(set(tickers)) != len(tickers), "tickers must be distinct and not empty"),
        (config.get("window_days", 7) < 1, "window_days must be at least 1"),
        (config.get("delay_seconds", 1.1) < 1.0, "delay_seconds must be at least 1.0"),
    ):
        if bad:
            raise ValueError(what)
    return config


def request_windows(spark: SparkSession, tickers: list[str], first: str, last: str, days: int) -> DataFrame:
    """(ticker, from_date, to_date) of windows of ``days`` days, both ends inclusive, the last shorter."""
    span = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"INTERVAL {int(days)} DAYS"))
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, tickers))).alias("ticker"), span.alias("_s")).select("ticker", F.explode("_s").alias("from_date"))
    return rows.withColumn("to_date", F.least(F.date_add("from_date", days - 1), F.lit(last).cast("date")))


def split_window(first: date, last: date) -> list[tuple[date, date]]:
    """A window's two halves, the first one as long or a day longer; a single day stays whole."""
    if first == last:
        return [(first, last)]
    middle = first + timedelta(days=(last - first).days // 2)
    return [(first, middle), (middle + timedelta(days=1), last)]


def pending_windows(windows: DataFrame, latest: DataFrame, threshold: int = 240) -> DataFrame:
    """Windows still to fetch: never finished, or finished with so many articles that they must be
    split (``split``)."""
    finished = latest.where(F.col("status").startswith("success") | F.col("status").startswith("split_") | F.col("status").startswith("unavailable"))
    keys = ["ticker", "from_date", "to_date"]
    new = windows.join(finished.select(*keys), keys, "left_anti").withColumn("split", F.lit(False))
    large = latest.where(F.col("status").startswith("success") & (F.col("article_count") >= threshold) & (F.col("from_date") < F.col("to_date")))
    return new.unionByName(windows.join(large.select(*keys), keys, "left_semi").withColumn("split", F.lit(True)))


def failure_state(http_status: Column, error_kind: Column) -> Column:
    """What a failed request is recorded as."""
    return (
        F.when(http_status.isin(401, 402, 403), "unavailable_auth_or_plan")
        .when(http_status == 429, "failed_rate_limited")
        .when(http_status >= 500, "failed_server_error")
        .when(http_status >= 400, "failed_client_error")
        .when(error_kind.isNotNull() & (error_kind != ""), F.concat(F.lit("failed_"), error_kind))
        .otherwise("failed_unknown")
    )


def fetch_patiently(fetch, *args, retries: int = 5, base: float = 2.0, most: float = 60.0, pause: float = 1.1, sleep=time.sleep):
    """Call ``fetch`` until it returns something other than a transient failure.

    It returns (status, body, retry_after). Waits double from ``base`` up to ``most`` seconds, a
    longer ``retry_after`` is honoured up to ``most``; every call is followed by ``pause``.
    """
    status, body, after = None, None, None
    for attempt in range(retries + 1):
        status, body, after = fetch(*args)
        sleep(pause)
        if status is not None and status not in (408, 425, 429) and status < 500:
            break
        if attempt < retries:
            sleep(min(most, max(base * 2**attempt, after or 0.0)))
    return status, body


def probe_windows(first: date, last: date, days: int = 2) -> list[tuple[date, date]]:
    """The windows at both ends of a range that tell whether the provider has it at all."""
    step = timedelta(days=days - 1)
    return [(first, min(first + step, last)), (max(last - step, first), last)]


def probe_state(count: int | None, status: int | None) -> str:
    """What a probe at an end of the range tells about the provider."""
    if status is None or status >= 400:
        return "probe_failed"
    return "confirmed_nonempty" if count else "empty_unverified"


class WindowedApi(DataSource):
    """Data source "windowed_api": request windows read through a user's function, a lane per partition.

    Options: ``fetch`` ("module:function" taking ticker, from and to and returning status, list of
    JSON objects and seconds to wait), ``windows`` (JSON list of [ticker, from, to]), ``pause`` (seconds
    between requests of all tasks together) and ``lanes`` (tasks at a time, 1 by default).
    """

    @classmethod
    def name(cls) -> str:
        return "windowed_api"

    def schema(self) -> str:
        return "ticker string, from_date string, to_date string, http_status int, position int, article string"

    def reader(self, schema) -> DataSourceReader:
        return _WindowReader(self.options)


class _WindowReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.windows = json.loads(options["windows"])
        self.fetch = options["fetch"]
        self.lanes = max(1, min(int(options.get("lanes", "1")), len(self.windows)))
        # lanes run side by side, so each waits as many times as long: the pace is that of all together
        self.pause = float(options.get("pause", "1.1")) * self.lanes

    def partitions(self):
        return [InputPartition(self.windows[k :: self.lanes]) for k in range(self.lanes)] if self.windows else []

    def read(self, partition):
        if partition is None:  # no windows at all
            return
        module, _, function = self.fetch.partition(":")
        for ticker, first, last in partition.value:
            status, body = fetch_patiently(getattr(importlib.import_module(module), function), ticker, first, last, pause=self.pause)
            if not body:
                yield (ticker, first, last, status, None, None)
            for i, article in enumerate(body or []):
                yield (ticker, first, last, status, i, json.dumps(article))
