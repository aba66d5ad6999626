"""Quote files in, partitioned bar and feature tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.functions.numeric import finite
from tallyweave.schemas import BAR_COLUMNS, BAR_TABLE, FEATURE_TABLE, QUOTE_FILE


def read_quotes(spark: SparkSession, glob: str, partitions: int | None = None) -> DataFrame:
    """Quotes from gzipped CSV files named `..._{symbol}.csv.gz`, or folders of parts so named.

    A gzip file is one task, and the ticks stay there: bars are aggregated file by file before anything moves, so only
    the partial bars of buckets are exchanged, and those that files share are merged. Work that needs the ticks
    themselves spread sets `partitions`, which spreads them by (symbol, minute).
    """
    raw = spark.read.schema(QUOTE_FILE).option("header", True).csv(glob)
    symbol = F.regexp_extract(F.input_file_name(), r"_([^_/]+)\.csv(?:\.gz)?(?:/[^/]*)?$", 1)
    quotes = raw.select(
        symbol.alias("symbol"), F.timestamp_micros("timestamp").alias("ts"), F.col("timestamp").alias("seq"),
        finite("bid_price").alias("bid_price"), finite("ask_price").alias("ask_price"),
    ).withColumn("mid_price", (F.col("bid_price") + F.col("ask_price")) / 2)
    return quotes.repartition(partitions, "symbol", F.date_trunc("minute", "ts")) if partitions else quotes


def with_month(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts))


def gathered(df: DataFrame, *folders: str) -> DataFrame:
    """Rows of one folder together, in shares of about the advised size."""
    return df.hint("rebalance", *[F.col(c) for c in folders])


def write_bars(bars: DataFrame, root: str) -> None:
    """One folder per symbol, frequency, year and month; only the folders present are replaced.

    Rows are gathered by folder; adaptive execution cuts a folder above `spark.sql.adaptive.advisoryPartitionSizeInBytes`
    into several tasks and puts small ones into one, so a folder has a file for each such share.
    """
    (gathered(with_month(bars), "symbol", "freq", "year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("symbol", "freq", "year", "month").parquet(root))


def load_bars(spark: SparkSession, root: str, symbol: str | None = None, freq: str | None = None) -> DataFrame:
    """Bars of one symbol and frequency by partition pruning; an empty result is an error, as it is for
    a missing folder."""
    bars = spark.read.schema(BAR_TABLE).parquet(root)
    if symbol is not None:
        bars = bars.where(F.col("symbol") == symbol)
    if freq is not None:
        bars = bars.where(F.col("freq") == freq)
    if bars.isEmpty():
        raise FileNotFoundError(f"no bars for {symbol} {freq} under {root}")
    return canonical_columns(bars, "symbol", "freq", "ts")


def canonical_columns(df: DataFrame, *keys: str) -> DataFrame:
    """Known bar columns as doubles, with the given keys; anything else is dropped."""
    return df.select(*[k for k in keys if k in df.columns],
                     *[finite(c).alias(c) for c in BAR_COLUMNS if c in df.columns])


def write_feature(features: DataFrame, root: str) -> None:
    (gathered(features, "feature_hash", "freq").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("feature_hash", "freq").parquet(root))


def read_feature(spark: SparkSession, root: str, feature_hash: str, freq: str) -> DataFrame:
    found = spark.read.schema(FEATURE_TABLE).parquet(root)
    return found.where((F.col("feature_hash") == feature_hash) & (F.col("freq") == freq))


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named numbers are all present and finite."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & finite(c).isNotNull()
    return df.where(keep)
