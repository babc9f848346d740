"""The vector store: Parquet partitioned by ticker and year, with a manifest and idempotent changes."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("ticker", "year")


def partition_key(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("unknown"))


def manifest(df: DataFrame) -> DataFrame:
    """ticker, year, num_chunks, path of each partition."""
    g = df.groupBy(partition_key("ticker").alias("ticker"), partition_key("year").alias("year")).agg(F.count(F.lit(1)).alias("num_chunks"))
    return g.withColumn("path", F.concat_ws("/", F.concat(F.lit("ticker="), "ticker"), F.concat(F.lit("year="), "year")))


def available(df: DataFrame) -> DataFrame:
    """One row: sorted distinct tickers and years; years that are no number are left out."""
    return df.agg(F.array_sort(F.collect_set("ticker")).alias("tickers"), F.array_sort(F.collect_set(F.col("year").try_cast("int"))).alias("years"))


class Collection:
    """A named collection under a root folder: created when first written, read with partition pruning. Its manifest (rows of
    each partition) is stored beside the data; a collection without one is discovered from its folders."""

    def __init__(self, spark: SparkSession, root: str, name: str = "sec_filings"):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"

    def exists(self) -> bool:
        try:
            self.spark.read.parquet(self.path)
            return True
        except AnalysisException:
            return False

    def read(self) -> DataFrame:
        """Folder names are text: a ticker of digits stays one."""
        df = self.spark.read.parquet(self.path)
        return self.spark.read.schema(", ".join(f"`{f.name}` {'string' if f.name in KEYS else f.dataType.simpleString()}" for f in df.schema)).parquet(self.path)

    def write(self, df: DataFrame, mode: str = "overwrite") -> None:
        """Rows are clustered by partition before the write, so a task opens few files; a large partition is split by AQE."""
        self._write(_keyed(df), mode)
        self._write_manifest(self._counted())

    def _write(self, keyed: DataFrame, mode: str) -> None:
        keyed.hint("rebalance", *[F.col(k) for k in KEYS]).write.mode(mode).option("partitionOverwriteMode", "static").partitionBy(*KEYS).parquet(self.path)

    def append(self, df: DataFrame, key: str = "chunk_id") -> None:
        """Adds the rows whose key is not yet in their partition (ticker, year); one that exists wins. Repeating an append changes
        nothing. Only the partitions the batch touches are read."""
        new = _keyed(df).dropDuplicates([*KEYS, key])
        if self.exists():
            touched = F.broadcast(new.select(*KEYS).distinct())  # one row per partition
            have = self.read().join(touched, [*KEYS], "left_semi").select(*KEYS, key)
            new = new.join(have, [*KEYS, key], "left_anti")
        self._write(new, "append")
        self._write_manifest(self._counted())

    def delete(self, predicate: Column) -> tuple[int, int]:
        """Removes the rows that satisfy the predicate; counts before and after. Only partitions with such rows change: what they
        keep is written aside, then each is replaced as a whole, and those that keep nothing are dropped. Partitions are
        replaced by the committer, so a driver that dies leaves each of them as it was or as it shall be."""
        if not self.exists():
            return 0, 0
        rows, hit = self.read(), F.coalesce(predicate, F.lit(False))
        counts = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("gone")).collect()  # one row per partition
        before, gone = sum(r.n for r in counts), sum(r.gone for r in counts)
        mixed = [r for r in counts if 0 < r.gone < r.n]
        fs, path = self._fs()
        if mixed:
            where = self.spark.createDataFrame([(r.ticker, r.year) for r in mixed], "ticker string, year string")
            aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
            rows.join(F.broadcast(where), [*KEYS]).filter(~hit).write.parquet(aside)
            kept = self.spark.read.schema(rows.schema).parquet(aside)
            kept.hint("rebalance", *[F.col(k) for k in KEYS]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(self.path)
            fs.delete(path(aside), True)
        for r in counts:
            if r.gone == r.n:
                fs.delete(path(self._folder(r.ticker, r.year)), True)
        if before == gone:
            self.drop()
        elif gone:
            self._write_manifest(self._counted())
        return before, before - gone

    def _folder(self, ticker: str, year: str) -> str:
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"{self.path}/ticker={escape(ticker)}/year={escape(year)}"

    def drop(self) -> bool:
        fs, path = self._fs()
        return bool(fs.delete(path(self.path), True))

    def recreate(self, df: DataFrame) -> None:
        """Drops what is there, whatever its columns, and starts anew."""
        self.drop()
        self.write(df)

    def manifest(self) -> DataFrame:
        """ticker, year, num_chunks, path: the stored manifest, or the counts of the folders where there is none."""
        try:
            return self.spark.read.parquet(f"{self.path}/_manifest")
        except AnalysisException:
            return self._counted()

    def _counted(self) -> DataFrame:
        return manifest(self.read().select(*KEYS))  # no column of the data is read

    def _write_manifest(self, counted: DataFrame) -> None:
        counted.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_manifest")  # one row per partition

    def info(self) -> dict:
        row = self.manifest().agg(F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("p")).first() if self.exists() else None
        return {"name": self.path.rsplit("/", 1)[1], "count": row.n if row else 0, "partitions": row.p if row else 0, "partitioned_by": list(KEYS)}

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(conf), path


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("ticker", partition_key("ticker")).withColumn("year", partition_key("year"))


def discover(spark: SparkSession, root: str) -> list[str]:
    """Names of the collections under a root folder, with or without a manifest."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName()[:1] not in "._" and Collection(spark, root, s.getPath().getName()).exists())


def new_rows(df: DataFrame, have: DataFrame, key: str, have_key: str) -> DataFrame:
    """Incremental load: rows whose key is not in ``have``."""
    return df.join(have.select(F.col(have_key).alias(key)), key, "left_anti")


def deletion_counts(df: DataFrame, predicate: Column) -> DataFrame:
    """before, deleted, after of a deletion that is not carried out."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("before"), F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("after"))
