"""Scans of the files that inventories read, and the report sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors see, under ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a scan, dealt out over the cores where its files give fewer splits than that: few, small files under a
    costly map. A scan with a split for every core is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def payloads(spark: SparkSession, path: str, column: str = "payload") -> DataFrame:
    """One JSON payload a line, with the file it is from."""
    return spark.read.text(path).select(F.col("value").alias(column), F.col("_metadata.file_path").alias("file"))


def payload_stream(spark: SparkSession, path: str, column: str = "payload") -> DataFrame:
    """The same as a stream."""
    return spark.readStream.text(path).select(F.col("value").alias(column))


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, text) of every file below a folder."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def xml_attributes(files: DataFrame, element: str, attributes: list[str]) -> DataFrame:
    """One row for each element with its attributes, from (file, text)."""
    tags = files.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(rf"<{element}\b[^>]*>"), F.lit(0))).alias("n", "tag"))
    pick = [F.nullif(F.regexp_extract("tag", rf"""\b{a}\s*=\s*["']([^"']*)["']""", 1), F.lit("")).alias(a) for a in attributes]
    return tags.select("file", "n", *pick)


def xml_values(files: DataFrame, element: str) -> DataFrame:
    """(file, value) for the text of each element."""
    return files.select("file", F.explode(F.expr(f"xpath(text, '//{element}/text()')")).alias("value"))


def json_files(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON documents under a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def matches(files: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """(file, n, match) for every match of a pattern in (file, text)."""
    return files.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("n", "match"))


def markdown_tables(files: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of pipe tables, cells picked by header name; a table that lacks a column gives NULL there."""
    parts = F.transform(F.split("text", "\r?\n"), lambda x: F.trim(x))
    lines = files.select("file", F.posexplode(parts).alias("n", "line")).where(F.col("line").startswith("|"))
    order = Window.partitionBy("file").orderBy("n")
    lines = lines.withColumn("table", F.col("n") - F.row_number().over(order))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.withColumn("cells", cells)
    head = F.first("cells").over(Window.partitionBy("file", "table").orderBy("n"))
    rows = rows.withColumn("head", head).where(~F.col("line").rlike(r"^\|[\s|:-]+\|?$") & (F.col("cells") != F.col("head")))  # no rule, no header
    pick = [F.when(F.array_position("head", c) > 0, F.get("cells", (F.array_position("head", c) - 1).cast("int"))).alias(c) for c in columns]
    return rows.select("file", "n", *pick)


def commit_log(spark: SparkSession, path: str, separator: str = "\0") -> DataFrame:
    """(seq, message) of a log whose messages end in a separator."""
    rows = spark.read.option("lineSep", separator).text(path).where(F.trim("value") != "")
    return rows.select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("message"))


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    """A text report, rows in their order, in one file."""
    df.select(F.col(column).cast("string")).coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
