"""What several corpus operators share: registration, words, folds and narrow scans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

#: A word is a run of anything but ASCII white space, in every operator of this package.
WORD = r"[^\x20\x09-\x0D]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(seed: str, *parts: Column) -> Column:
    """60 bits that depend on the seed and the row's key only, so a rerun draws the same ones."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *texts)), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def fold(doc_id: Column, folds: int) -> Column:
    """The document's fold: crc32 of its id as text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


#: Rows of an Arrow batch of whole texts; Spark's 10,000 would hold a gigabyte of long ones.
TEXTS_PER_BATCH = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, as whole texts go to Python from here."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXTS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)


def spread(scan: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """The given columns of a scan, over at least as many tasks as the cluster has cores.

    A table in one row group is read by one task. Its rows are dealt out before the costly work;
    a scan with enough splits is left alone, so large tables are not shuffled. Only for plans
    without an exchange: asking for the number of tasks would run one.
    """
    narrow = scan.select(*columns)
    bound_batches(scan.sparkSession)
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return narrow.repartition(cores) if narrow.rdd.getNumPartitions() < cores else narrow


def within(df: DataFrame, key: Column, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows drawn by a hash of ``key``, all of them if there are no more."""
    n = df.count()
    if n <= rows:
        return df
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30))
    return df.filter(draw < int(rows / n * (1 << 30)))
