"""Readers of landed files and databases, and probes of what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.pages import FEED_PARTS


def database_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, properties: dict[str, str]) -> DataFrame:
    """A database table read in ranges of an integer key, with the given connection properties."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)


def has_column(df: DataFrame, name: str) -> bool:
    """Whether a table has a column."""
    return name in df.columns


def has_table(spark: SparkSession, name: str) -> bool:
    """Whether the catalog has a table."""
    return spark.catalog.tableExists(name)


def user_specs(spark: SparkSession, path: str) -> DataFrame:
    """(profile_url, import_username) from JSON files: an array, or an object with one under candidates, users or items."""
    item = "struct<profile_url:string,import_username:string>"
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"candidates array<{item}>, users array<{item}>, items array<{item}>")
    plain = F.when(F.startswith(F.btrim("value", F.lit(" \n\t")), F.lit("[")), F.from_json("value", f"array<{item}>"))
    rows = text.select(F.explode(F.coalesce(plain, wrapped["candidates"], wrapped["users"], wrapped["items"])).alias("s"))
    return rows.select("s.*").filter("profile_url IS NOT NULL")


def digit_ids(text: Column) -> Column:
    """Array of the all-digit ids of a text, split on white space and commas; # begins a comment up to the line's end."""
    return F.filter(F.split(F.regexp_replace(text, r"#[^\n]*", ""), r"[\s,]+"), lambda t: t.rlike("^[0-9]+$"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids of text files."""
    return spark.read.text(path).select(F.explode(digit_ids(F.col("value"))).alias("id")).distinct()


def best_report(reports: DataFrame) -> DataFrame:
    """The report to show: several algorithms before one, then more negatives, then the latest."""
    usable = reports.filter(~F.contains("file", F.lit("_legacy")))
    order = F.struct((F.size("algorithms") > 1).alias("multi"), "num_negatives", "generated_at", "modified")
    return usable.agg(F.max_by(F.struct(*usable.columns), order).alias("r")).filter("r IS NOT NULL").select("r.*")


def report_files(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation reports landed as JSON, with file name and time."""
    schema = "algorithms array<string>, num_negatives int, generated_at string"
    found = spark.read.schema(schema).option("multiLine", True).json(path)
    return found.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def xml_feeds(spark: SparkSession, path: str, slug: Column) -> DataFrame:
    """(slug, xml) of landed feed files; ``slug`` is made from the column ``file``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select("value", F.col("_metadata.file_name").alias("file")).select(slug.alias("slug"), F.col("value").alias("xml"))


def feed_rows(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """(title, link, description, pubDate, guid, file) of the items of landed feeds, in batch or as a stream of new files.

    Each file is one document with a root, read by one task item by item, never held as
    one text.
    """
    source = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    raw = source.format("xml").option("rowTag", "item").schema(", ".join(f"{tag} string" for tag in FEED_PARTS)).load(path)
    return raw.select(*FEED_PARTS, F.col("_metadata.file_name").alias("file"))
