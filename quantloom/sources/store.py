"""Tables at rest: slices of the feature store, raw bars, snapshots, lineage and results.

A slice is Parquet, partitioned by a hash bucket of the ticker and sorted by (ticker, date) inside files: a
ticker read prunes to one bucket folder and to the row groups of that ticker, and the number of folders does not
grow with the universe. Every change writes the buckets it touches as a new version beside the old ones and then commits a manifest that
names one version per bucket. Readers see a change whole or not at all, a writer that stops half-way changes nothing, and of two writers
at a time the later one starts again from the earlier one's result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from quantloom.operators.merge import merge_history, stack
from quantloom.operators.panel import combined
from quantloom.session import shared_dir
from quantloom.sources.manifest import CommitConflict, Manifests

SLICES = ("bars", "technical", "fundamental", "sentiment", "combined", "state", "articles")
BUCKET = "ticker_bucket"
ATTEMPTS = 20  # of a commit that other writers keep overtaking

NEWS_SCHEMA = "ticker string, title string, content string, source string, url string, published_at string"


class SliceStore:
    """Load, save and check slices by name under one root folder.

    ``state`` and ``articles`` hold what an incremental refresh starts from (``plans/workflows.py``).
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def path(self, name: str) -> str:
        if name not in SLICES:
            raise ValueError(f"unknown slice {name!r}, expected one of {', '.join(SLICES)}")
        return f"{self.root}/{name}"

    def _bucket(self, ticker) -> F.Column:
        return F.pmod(F.hash(ticker), F.lit(self.buckets))

    def _manifests(self, name: str) -> Manifests:
        return Manifests(self.spark, f"{self.path(name)}/manifest")

    def _read(self, name: str, content: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        """The versions that a manifest names, of all buckets or of some."""
        data = f"{self.path(name)}/data"
        named = {int(b): v for b, v in content["buckets"].items() if buckets is None or int(b) in buckets}
        schema = T.StructType.fromJson(content["schema"])
        if not named:
            return self.spark.createDataFrame([], schema)
        # versions that supply every bucket they hold are read as one folder; at most one path per bucket otherwise
        paths = [f"{data}/store_version={v}/{BUCKET}={b}" for b, v in sorted(named.items())]
        reading = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(reading).option("basePath", data).parquet(*paths).drop("store_version")

    def _commit(self, name: str, touched: Sequence[int], make: Callable[[DataFrame | None], DataFrame]) -> None:
        """Write what ``make`` gives for the stored rows of the touched buckets, then commit; start again if another writer came first."""
        manifests = self._manifests(name)
        for _ in range(ATTEMPTS):
            number, content = manifests.latest()
            before = None if content is None else self._read(name, content, touched).drop(BUCKET)
            rows = make(before)
            version = uuid.uuid4().hex
            out = rows.withColumn(BUCKET, self._bucket(F.col("ticker")))
            out = out.repartition(BUCKET, F.col("ticker")).sortWithinPartitions(BUCKET, "ticker", "date")
            target = f"{self.path(name)}/data/store_version={version}"
            out.write.partitionBy(BUCKET).parquet(target)
            present = [int(f.split("=")[1]) for f in manifests.folders(target) if f.startswith(f"{BUCKET}=")]
            old = {} if content is None else {b: v for b, v in content["buckets"].items() if int(b) not in set(touched)}
            schema = rows.schema if content is None else _widened(T.StructType.fromJson(content["schema"]), rows.schema)
            try:
                manifests.add(number + 1, {"buckets": old | {str(b): version for b in present}, "schema": schema.jsonValue()})
                return
            except CommitConflict:
                manifests.remove(target)
        raise RuntimeError(f"other writers overtook this change of {name} {ATTEMPTS} times")

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the tickers given; at most ``buckets`` numbers reach the driver."""
        return sorted(r[0] for r in rows.select(self._bucket(F.col("ticker"))).distinct().collect())

    def _fixed(self, df: DataFrame) -> DataFrame:
        """``df`` evaluated once, in the shared folder."""
        shared_dir(self.spark)
        return df.checkpoint()

    def save(self, name: str, df: DataFrame) -> None:
        """Replace the tickers given; others in their buckets stay (A5, A14). Refuses an empty frame and the derived ``combined`` view."""
        self.path(name)  # refuses unknown names
        if name == "combined":
            raise ValueError("combined is derived from the other slices")
        df = self._fixed(df)
        touched = self._touched(df)
        if not touched:
            raise ValueError(f"refusing to save an empty {name} slice")
        given = df.select("ticker").distinct()
        self._commit(name, touched, lambda old: df if old is None else stack([df, old.join(given, "ticker", "left_anti")]))

    def merge(self, name: str, increment: DataFrame, keys: Sequence[str] = ("ticker", "date")) -> None:
        """Keep-last merge of an increment into the stored slice, rewriting only the buckets it touches."""
        increment = self._fixed(increment)
        touched = self._touched(increment)
        if touched:
            self._commit(name, touched, lambda old: merge_history(old, increment, keys))

    def replace_from(self, name: str, rows: DataFrame, first: DataFrame) -> None:
        """Replace each ticker of ``first`` (ticker, first) from that day on by ``rows``; earlier rows and other tickers stay."""
        rows = self._fixed(rows)
        touched = self._touched(first)

        def replaced(old: DataFrame | None) -> DataFrame:
            if old is None:
                return rows
            kept = old.join(first.select("ticker", "first"), "ticker", "left").filter("first is null or date < first").drop("first")
            return stack([kept, rows])

        if touched:
            self._commit(name, touched, replaced)

    def load(self, name: str, ticker: str | None = None) -> DataFrame | None:
        """The slice, or one ticker of it; None when it was never saved."""
        if name == "combined":
            technical = self.load("technical", ticker)
            return None if technical is None else combined(technical, self.load("fundamental", ticker), self.load("sentiment", ticker))
        _, content = self._manifests(name).latest()
        if content is None:
            return None
        df = self._read(name, content)
        if ticker is not None:
            key = ticker.strip().upper()
            df = df.filter((F.col(BUCKET) == self._bucket(F.lit(key))) & (F.col("ticker") == key))
        return df.drop(BUCKET)

    def load_tickers(self, name: str, tickers: DataFrame) -> DataFrame | None:
        """Stored rows of some tickers; only their buckets' files are read."""
        _, content = self._manifests(name).latest()
        if content is None:
            return None
        return self._read(name, content, self._touched(tickers)).drop(BUCKET).join(tickers.select("ticker").distinct(), "ticker", "left_semi")

    def exists(self, name: str, ticker: str | None = None) -> bool:
        df = self.load("technical" if name == "combined" else name, ticker)
        return df is not None and not df.isEmpty()

    def tickers(self, name: str = "bars") -> DataFrame:
        """Distinct upper-case tickers, sorted (A2)."""
        return self.load(name).select(F.upper("ticker").alias("ticker")).distinct().orderBy("ticker")

    def drop_old_versions(self, name: str) -> int:
        """Delete data that the newest manifest does not name, such as replaced buckets and half-written changes; run it while nobody writes or reads older data."""
        manifests = self._manifests(name)
        _, content = manifests.latest()
        live = {f"store_version={v}" for v in (content or {"buckets": {}})["buckets"].values()}
        data = f"{self.path(name)}/data"
        gone = [f for f in manifests.folders(data) if f not in live]
        for folder in gone:
            manifests.remove(f"{data}/{folder}")
        return len(gone)


def _widened(old: T.StructType, new: T.StructType) -> T.StructType:
    """Columns of both; rows of files that lack one read NULL there."""
    have = {f.name for f in old.fields}
    return T.StructType([*old.fields, *[f for f in new.fields if f.name not in have]])


def write_json_records(df: DataFrame, path: str) -> None:
    """Snapshots and articles as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_fundamentals(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Snapshot objects, every value text; absent keys are NULL (A3)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["ticker", *fields]])
    return spark.read.schema(schema).json(path)


def read_news(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Articles from JSON lines or from one array per file; an absent folder or a non-list is empty (A4)."""
    try:
        df = spark.read.schema(NEWS_SCHEMA).option("multiLine", multi_line).json(path)
    except AnalysisException:
        return spark.createDataFrame([], NEWS_SCHEMA)
    return df.filter(F.coalesce("title", "content", "url", "published_at").isNotNull())


def write_result(df: DataFrame, path: str) -> None:
    """Result tables as CSV with a header (A17); small by nature, so partitions are left as they come."""
    df.write.mode("overwrite").option("header", True).csv(path)


def nest_curves(curve: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One record per run with its dated curve as an array (A18); a curve is bounded by the calendar."""
    return curve.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", *columns))).alias("equity_curve"))


def unnest_curves(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.select(*keys, F.inline("equity_curve"))


def append_lineage(df: DataFrame, path: str) -> None:
    """Append-only lineage rows."""
    df.write.mode("append").json(path)


def artifact_freshness(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Files, bytes and newest modification time of each artifact folder, from file metadata alone."""
    parts = []
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
        parts.append(files.select(F.lit(name).alias("artifact"), "path", "length", "modificationTime"))
    return (
        stack(parts)
        .groupBy("artifact")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified_at"))
        .withColumn("exists", F.lit(True))
        .withColumn("age_sec", F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("modified_at"))
    )


def data_freshness(bars: DataFrame) -> DataFrame:
    """Last stored date of every ticker and its distance to the newest date of all."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_date"))
    newest = last.agg(F.max("last_date").alias("m")).first()["m"]  # one value
    return last.withColumn("days_behind", F.datediff(F.lit(newest), F.col("last_date")))
