"""Bar store on Parquet: upsert by key, range scans, statistics, retention.

Daily bars lie under exchange and year and are sorted by symbol and date inside the
files, so a symbol and range scan prunes folders and row groups; one file per symbol
would drown a large universe in small files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.functions.symbols import exchange_of
from tidemark.session import remove

BAR_FIELDS = ("open", "high", "low", "close", "volume", "amount")


def read_table(spark: SparkSession, root: str) -> DataFrame | None:
    """The stored table, or None where nothing is stored yet."""
    try:
        return spark.read.parquet(root)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def keep_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Newest row per key. Each task keeps one row per key before the shuffle, so a
    pile of copies never meets in one place."""
    newest = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") == 1).drop("__n")


def upsert(spark: SparkSession, new: DataFrame, root: str, keys: Sequence[str], partitions: Sequence[str], seq: str) -> None:
    """Merge rows into a partitioned table, last write wins.

    Only partitions the new rows touch are read and rewritten, so a key must fix its partition.
    Both sides carry ``seq``; rows of one batch are ordered by it, then by their content as
    JSON, and a batch beats what is stored. Files follow the data's size.
    """
    old = read_table(spark, root)
    merged = new.withColumn("__batch", F.lit(1))
    if old is not None:
        touched = new.select(*partitions).distinct()
        merged = merged.unionByName(
            old.join(touched, list(partitions), "left_semi").withColumn("__batch", F.lit(0)), allowMissingColumns=True
        )
    merged = merged.withColumn("__order", F.struct("__batch", seq, F.to_json(F.struct(*new.columns))))
    out = keep_last(merged, keys, "__order").drop("__batch", "__order")
    (
        out.hint("rebalance", *partitions)
        .sortWithinPartitions(*partitions, *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*partitions)
        .parquet(root)
    )


def write_daily_bars(spark: SparkSession, bars: DataFrame, root: str, seq: str | None = None) -> None:
    """Add exchange and visibility (the day after) and upsert by (symbol, date)."""
    stamped = bars.withColumns(
        {
            "exchange": exchange_of(F.col("symbol")),
            "year": F.year("date"),
            "visibility_ts": F.date_add("date", 1).cast("timestamp"),
            "ingest_seq": F.col(seq).cast("bigint") if seq else F.lit(0).cast("bigint"),
        }
    )
    if seq and seq != "ingest_seq":
        stamped = stamped.drop(seq)
    upsert(spark, stamped, root, ["symbol", "date"], ["exchange", "year"], "ingest_seq")


def read_daily_bars(spark: SparkSession, root: str, symbols: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
    """Inclusive range of the asked symbols; nothing stored gives no rows."""
    df = read_table(spark, root)
    if df is None:
        return spark.createDataFrame(
            [], "symbol string, date date, open double, high double, low double, close double, volume bigint, amount double"
        )
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
        df = df.where(F.col("exchange").isin(sorted({s.split(".")[1] for s in symbols if "." in s}))) if all(
            "." in s for s in symbols
        ) else df
    for bound, cmp, year in ((start, "__ge__", "__ge__"), (end, "__le__", "__le__")):
        if bound is not None:
            day = F.lit(bound).cast("date")
            df = df.where(getattr(F.col("date"), cmp)(day) & getattr(F.col("year"), year)(F.year(day)))
    return df.select("symbol", "date", *[c for c in BAR_FIELDS if c in df.columns])


def write_minute_bars(bars: DataFrame, root: str, period: int) -> None:
    """One folder per period, exchange and day; a rewritten day replaces the old one."""
    (
        bars.withColumns(
            {
                "period": F.lit(period),
                "exchange": exchange_of(F.col("symbol")),
                "date": F.to_date("datetime"),
                "visibility_ts": F.col("datetime") + F.make_dt_interval(mins=F.lit(period)),
            }
        )
        .hint("rebalance", "exchange", "date")
        .sortWithinPartitions("exchange", "date", "symbol", "datetime")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("period", "exchange", "date")
        .parquet(root)
    )


def read_minute_bars(spark: SparkSession, root: str, period: int, start=None, end=None) -> DataFrame:
    df = spark.read.parquet(root).where(F.col("period") == period)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def read_code(spark: SparkSession, root: str, code: str, start=None, end=None, freq: str = "D") -> DataFrame:
    """Read by frequency: ``D`` for days, a number for minutes."""
    if freq == "D":
        return read_daily_bars(spark, root, [code], start, end)
    return read_minute_bars(spark, root, int(freq), start, end).where(F.col("symbol") == code)


def write_code(spark: SparkSession, root: str, bars: DataFrame, freq: str = "D") -> None:
    if freq == "D":
        write_daily_bars(spark, bars, root)
    else:
        write_minute_bars(bars, root, int(freq))


def list_symbols(spark: SparkSession, root: str) -> DataFrame:
    df = read_table(spark, root)
    return spark.createDataFrame([], "symbol string") if df is None else df.select("symbol").distinct()


def statistics(spark: SparkSession, root: str) -> DataFrame:
    """Symbols, rows, files and stored bytes per exchange, from the scan's own metadata."""
    df = spark.read.parquet(root).select(
        "exchange", "symbol", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")
    )
    per_file = df.groupBy("exchange", "path", "bytes").agg(F.count(F.lit(1)).alias("rows"))
    files = per_file.groupBy("exchange").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")
    )
    symbols = df.select("exchange", "symbol").distinct().groupBy("exchange").agg(F.count(F.lit(1)).alias("symbols"))
    return files.join(symbols, "exchange")


def drop_old_days(spark: SparkSession, root: str, target: str, as_of, keep_days: int = 365) -> None:
    """Copy what retention keeps to ``target``; folders of older days are never read."""
    kept = spark.read.parquet(root).where(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), keep_days))
    kept.write.mode("overwrite").partitionBy("period", "exchange", "date").parquet(target)


def expire_days(spark: SparkSession, root: str, as_of, keep_days: int = 365) -> int:
    """Delete the folders of days that retention no longer keeps, and tell how many.

    Only partition values are looked at; the driver holds one name for each expired folder.
    A job that stopped half way is finished by the next call.
    """
    old = spark.read.parquet(root).where(F.col("date") < F.date_sub(F.lit(as_of).cast("date"), keep_days))
    gone = 0
    for name in old.select(F.regexp_extract("_metadata.file_path", "^(.*)/[^/]+$", 1).alias("folder")).distinct().toLocalIterator():
        remove(spark, name["folder"])
        gone += 1
    return gone


def missing_symbols(requested: DataFrame, stored: DataFrame, start, end) -> DataFrame:
    """Symbols asked for without a row in the range: what still has to be pulled."""
    present = stored.where(F.col("date").between(start, end)).select("symbol").distinct()
    return requested.select("symbol").distinct().join(present, "symbol", "left_anti")


def files_without_columns(spark: SparkSession, root: str, required: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Every stored file and the required columns it lacks, one task per file.

    Only the footers are read.
    """
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root).select("path")
    )
    need = list(required)

    def footers(batches):
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            lacking = []
            for path in batch["path"]:
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(inner) as f:
                    names = set(pq.ParquetFile(f).schema_arrow.names)
                lacking.append([c for c in need if c not in names])
            batch["lacking"] = lacking
            yield batch[["path", "lacking"]]

    return listed.mapInPandas(footers, "path string, lacking array<string>").where(F.size("lacking") > 0)
