"""Formats of puzzle corpora: CSV with every field a string, markdown tables; the shared folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of the machine only in local mode, where the session names none; on a cluster that is an error."""
    conf = spark.sparkContext.getConf()
    at = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not at and not (conf.get("spark.master") or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (at or "file:///tmp/checkpoints").rstrip("/")


def hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path, as Spark itself has them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at


def scratch(spark: SparkSession, name: str, passing: bool = True) -> str:
    """A new path in the shared folder; a passing one goes when the driver ends."""
    path = f"{shared_dir(spark)}/tracewright/{name}-{uuid.uuid4().hex}"
    if passing:
        system, at = hadoop(spark, path)
        system.deleteOnExit(at)
    return path


def materialised(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, so a lost executor costs no rerun of what came before."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of an address and the path there, for tasks; s3a and s3n are names that Hadoop has for s3."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    uri = f"s3://{rest}" if scheme in ("s3a", "s3n") else uri
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def first_existing(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The paths that the first pattern with any gives, sorted; none where no pattern has."""
    for pattern in patterns:
        system, at = hadoop(spark, pattern)
        found = system.globStatus(at)
        if found:
            return sorted(s.getPath().toString() for s in found)
    return []


def replace_table(df: DataFrame, path: str) -> None:
    """df as the new content of a table. It is written beside the old one, then a pointer file is renamed over the old pointer in one step: readers see one or the other, whole."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    system, new = hadoop(spark, f"{path}/_next-{version}")
    out = system.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf)
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT"), over)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the pointer of a replaced table names."""
    version = spark.read.text(f"{path}/CURRENT").first()["value"]
    return spark.read.schema(schema).parquet(f"{path}/{version}")


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Fields are strings whatever they look like; quotes are doubled, line breaks stay inside fields, size has no limit."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n").csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """A job commits its files at its end, so readers see all or none of them."""
    df.select(*(F.col(c).cast("string").alias(c) for c in columns)).write.mode(mode).options(header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def audit_table(lines: DataFrame) -> DataFrame:
    """(id, score, reason) of the rows of markdown tables in lines (value): the second field holds a score of 0 to 10."""
    cells = F.transform(F.split("value", r"\|", -1), lambda s: F.trim(s))
    score = F.regexp_extract(cells[2], r"\b(10|[0-9])\b", 1)
    rows = lines.filter(F.startswith(F.trim("value"), F.lit("|"))).select(cells.alias("cells"), score.alias("score"))
    return rows.filter((F.size("cells") >= 4) & (F.col("score") != "")).select(F.col("cells")[1].alias("id"), F.col("score").cast("int").alias("score"), F.col("cells")[3].alias("reason"))
