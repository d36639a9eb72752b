"""Parquet and CSV reading with differing columns, and the sinks."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_present(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Wanted columns of parts whose schemas differ; a column absent everywhere is null."""
    d = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
    return d.select(*[(F.col(c).try_cast(t) if c in d.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV or parquet by suffix."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", "true")
        return (reader.schema(schema) if schema else reader).csv(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError("Use .csv or .parquet")


def write_parquet(df: DataFrame, path: str, partitions: list[str] = ()) -> None:
    """zstd parquet; the commit protocol makes the replacement atomic per job."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partitions).parquet(path)


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """Evidence CSV with rounded numbers."""
    out = df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    out.write.mode("overwrite").option("header", "true").csv(path)


def content_id(df: DataFrame) -> DataFrame:
    """One row naming the content: count and order-free sums of two row hashes."""
    h = [F.sum(F.pmod(F.xxhash64(*[F.col(c) for c in sorted(df.columns)], F.lit(s)), F.lit(1 << 40)).cast("decimal(38,0)")) for s in (1, 2)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", F.count(F.lit(1)), *h), 256).alias("content_id"))


def write_by_content(df: DataFrame, folder: str) -> str:
    """Write under the content id; the same content is written once."""
    spark = df.sparkSession
    cid = content_id(df).first()["content_id"]
    path = f"{folder}/content={cid}"
    try:
        spark.read.parquet(path)
    except AnalysisException:
        write_parquet(df, path)
    return path


def manifest(df: DataFrame) -> DataFrame:
    """Rows kept and columns per input file of a scan."""
    return df.withColumn("_f", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).groupBy(F.col("_f").alias("file")).agg(
        F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
