"""Catalog of CSV exports from one parallel text scan.

A single job reads all given files as lines and keeps a row a file: its header,
its lines, and the lines with an odd number of quotes. Where there is none, no
quoted value holds a line break and every line is a record, so the file can be
split and read by many tasks; otherwise a record may span lines and the file is
read as a whole. A folder of part files whose name ends in ``.csv`` is one file.

Defined cases: an empty file has no row; a folder whose parts differ in their
header, and a header with empty or repeated names (in any case), is not
splittable.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.columns import norm_label
from revlens.sources import ingest
from revlens.sources.registry import MODULES, alias_lookup


def file_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(File_Path, File_Name, Columns, Lines, Open_Lines, Splittable) of every file; ``Lines`` leaves out headers."""
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("url"), place.alias("place"))
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    parts = lines.groupBy("url").agg(F.min_by("value", "place").alias("header"), F.count(F.lit(1)).alias("lines"), F.count_if(quotes % 2 == 1).alias("open"))
    parts = parts.withColumn("part", F.url_decode(F.replace("url", F.lit("+"), F.lit("%2B"))))
    folder = F.regexp_extract("part", r"^(.*?\.[cC][sS][vV])(?:/|$)", 1)
    path = F.when(folder != "", folder).otherwise(F.col("part"))
    files = parts.groupBy(path.alias("File_Path")).agg(
        F.min("header").alias("header"), (F.min("header") == F.max("header")).alias("same"), (F.sum("lines") - F.count(F.lit(1))).alias("Lines"), F.sum("open").alias("Open_Lines"))
    fields = F.split(F.regexp_replace("header", "^\ufeff", ""), r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    names = F.transform(fields, lambda c: F.replace(F.regexp_replace(c, '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    files = files.withColumn("Columns", names)
    distinct = F.size(F.array_distinct(F.transform("Columns", F.lower))) == F.size("Columns")
    plain = (F.col("Open_Lines") == 0) & F.col("same") & distinct & F.forall("Columns", lambda c: F.trim(c) != "") & ~F.col("header").startswith("\ufeff")
    return files.select("File_Path", F.substring_index("File_Path", "/", -1).alias("File_Name"), "Columns", "Lines", "Open_Lines", plain.alias("Splittable"))


def detect_modules(catalog: DataFrame) -> DataFrame:
    """A8 for a catalog: each file's module by the aliases in its name (whole words, registry order), else by its headers."""
    spark = catalog.sparkSession
    aliases = spark.createDataFrame(list(alias_lookup().items()), "label string, canonical string")  # fixed: about 150 rows
    headers = catalog.select("File_Path", F.explode("Columns").alias("header"))
    known = headers.join(F.broadcast(aliases), norm_label("header") == F.col("label"), "left")
    columns = known.select(F.col("File_Path").alias("file_name"), F.coalesce("canonical", "header").alias("column_name")).distinct()
    scored = ingest.detect_modules_table(spark, columns).select(F.col("file_name").alias("File_Path"), F.col("module").alias("by_columns"), "score")
    counts = known.groupBy("File_Path").agg(F.count("canonical").alias("Known_Columns"))
    label = norm_label(F.regexp_replace("File_Name", r"\.[A-Za-z0-9]+$", ""))
    by_name = F.coalesce(*[F.when(label.rlike("(^| )(" + "|".join(d.aliases) + ")( |$)"), name) for name, d in MODULES.items()])
    out = catalog.withColumn("by_name", by_name).join(scored, "File_Path", "left").join(counts, "File_Path", "left")
    return out.select("File_Path", "File_Name", F.coalesce("by_name", "by_columns", F.lit("Unknown")).alias("Module"),
                      F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_columns").isNotNull(), "columns").alias("Found_By"),
                      F.col("score").alias("Column_Score"), F.size("Columns").alias("Header_Columns"), "Known_Columns", "Lines", "Open_Lines", "Splittable")


def _plain(path: str) -> str:
    """A path without scheme and host, as the caller and the scan may write them differently."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?", "", path).rstrip("/")


def open_splittable(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Readers, all columns strings, of those ``paths`` that many tasks can read: headers come from the catalog, no job a file."""
    rows = file_catalog(spark, paths).where("Splittable").select("File_Path", "Columns").collect() if paths else []  # a row a given file
    found = {_plain(r["File_Path"]): r["Columns"] for r in rows}
    out = {}
    for p in paths:
        columns = found.get(_plain(p))
        if columns:
            schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
            out[p] = spark.read.schema(schema).options(**ingest.CSV, mode="PERMISSIVE").csv(p)
    return out
