"""Writers. All are plain Spark writes; none brings rows to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 2_000_000  # per file, which also bounds what a file hash must hold


def save_dataset(df: DataFrame, root: str, symbol: str, tf: str, start, end, fmt: str = "parquet") -> str:
    path = f"{root}/{symbol}_{tf}_{'start' if start is None else start}_{'latest' if end is None else end}.{fmt}"
    w = df.write.mode("overwrite").option("maxRecordsPerFile", MAX_ROWS)
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)
    return path


def save_partitioned(df: DataFrame, path: str, *by: str) -> str:
    """Hive-partitioned zstd parquet, rows brought together by partition before the write."""
    (
        df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(8)))
        .write.mode("overwrite")
        .partitionBy(*by)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", MAX_ROWS)
        .parquet(path)
    )
    return path


def save_daily(df: DataFrame, path: str, ts: str) -> str:
    return save_partitioned(df.withColumn("day", F.to_date(F.timestamp_millis(F.col(ts)))), path, "day")


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs to dotted columns; arrays and maps to JSON text."""

    def walk(schema: T.StructType, prefix: str):
        for f in schema.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            quoted = ".".join(f"`{p}`" for p in path.split("."))
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                yield F.to_json(F.col(quoted)).alias(path)
            else:
                yield F.col(quoted).alias(path)

    return df.select(*walk(df.schema, ""))


def save_jsonl(df: DataFrame, path: str) -> tuple[str, str]:
    """JSON lines next to flattened parquet."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}.jsonl")
    flatten(df).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}.parquet")
    return f"{path}.jsonl", f"{path}.parquet"


def save_bundle(tables: dict[str, DataFrame], path: str) -> str:
    """A named set of tables; decision and outcome tables stay in separate folders."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}.json")
        flatten(df).write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
    return path


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and size of every data file under a folder."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .filter(~F.element_at(F.split("path", "/"), -1).rlike("^[._]"))
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    )


def manifest_drift(now: DataFrame, saved: DataFrame) -> DataFrame:
    a = now.select("file", F.col("sha256").alias("now"))
    b = saved.select("file", F.col("sha256").alias("saved"))
    return (
        a.join(b, "file", "full_outer")
        .filter(~F.col("now").eqNullSafe(F.col("saved")))
        .withColumn(
            "change",
            F.when(F.col("saved").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").otherwise("CHANGED"),
        )
    )
