"""Readers: files, corpora, prior scans, labels, profiles. Schemas are explicit; malformed values become defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.operators.feedback import NEGATIVE, POSITIVE
from sievewright.operators.records import kind

SCAN = """schema_version int, summary map<string,string>, items array<struct<path:string,name:string,kind:string,status:string,size_bytes:string,error:string,duplicate_of:string,
  result:struct<score:string,band:string,signals:array<struct<title:string,detail:string,weight:string>>,source_guess:struct<label:string,confidence:string,reasons:array<string>>>>>"""
SIDECARS = r"\.(ivy|model)\.json$"


def files(spark: SparkSession, root: str, recursive: bool = True, max_bytes: int | None = None, max_files: int | None = None) -> DataFrame:
    """Rows (path, kind, status, size_bytes, modified, content) of the files under a folder.

    Sidecars are left out.  Files over ``max_bytes`` have status skipped and no
    content; their bytes are not read.  ``max_files`` is the tool's own cap, off
    by default; with it a column ``capped`` says whether files were left out (see
    :func:`capped`).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    all_ = reader.load(root).where(~F.col("path").rlike(SIDECARS))
    small = all_ if max_bytes is None else all_.where(F.col("length") <= max_bytes)
    row = lambda d, status, content: d.select("path", kind(F.col("path")).alias("kind"), F.lit(status).alias("status"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), content.alias("content"))
    out = row(small, "pending", F.col("content"))
    if max_bytes is not None:
        out = out.unionByName(row(all_.where(F.col("length") > max_bytes), "skipped", F.lit(None).cast("binary")))
    return out if max_files is None else capped(out, "path", max_files)


def capped(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first ``most`` rows in order, and ``capped``: whether there are more; one row more is looked for, not all counted."""
    first = rows.orderBy(order).limit(most + 1).withColumn("_place", F.row_number().over(Window.orderBy(order)))  # ``most`` rows, a parameter
    more = first.agg((F.count("*") > most).alias("capped"))
    return first.where(F.col("_place") <= most).drop("_place").crossJoin(more)  # one row


def text_prefix(content: Column, n: int = 65536) -> Column:
    """The first bytes as UTF-8; damaged bytes become replacement letters."""
    return F.make_valid_utf8(F.substring(content, 1, n).cast("string"))


def number(x: Column, default: int = 0) -> Column:
    """A whole number from loose text, else the default."""
    return F.coalesce(x.try_cast("double").cast("long"), F.lit(default).cast("long"))


def scan_items(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Items of earlier scan documents, with malformed numbers as 0 and missing texts as empty.

    A document is a file, or a line, so that a large file can be split.
    """
    d = spark.read.schema(SCAN).option("multiLine", str(not lines).lower()).option("mode", "PERMISSIVE").json(path).select(F.explode("items").alias("i"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return d.select(
        text("i.path").alias("path"), text("i.name").alias("name"), text("i.kind").alias("kind"), F.coalesce("i.status", F.lit("failed")).alias("status"), number(F.col("i.size_bytes")).alias("size_bytes"),
        F.least(F.greatest(number(F.col("i.result.score")), F.lit(0)), F.lit(100)).cast("int").alias("score"), F.coalesce("i.result.band", F.lit("unknown")).alias("band"),
        F.coalesce(F.transform("i.result.signals", lambda s: F.struct(F.coalesce(s["title"], F.lit("")).alias("title"), F.coalesce(s["detail"], F.lit("")).alias("detail"), number(s["weight"]).cast("int").alias("weight"))), F.array().cast("array<struct<title:string,detail:string,weight:int>>")).alias("signals"),
        F.coalesce("i.result.source_guess.confidence", F.lit("unknown")).alias("source_confidence"), "i.error", "i.duplicate_of",
    )


_ENTRY = "struct<path:string,file:string,expected_label:string,label:string,expected:string,verdict:string,notes:string>"


def feedback(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows (path, label 0/1, expected_label, notes) of examiner labels.

    Reads JSON lines, an array, an object that holds one under records, items,
    feedback or entries, or a lone object.  Rows without a path or a known label go.
    With ``lines`` every line is such a text, so that a large file can be split.
    """
    whole = spark.read.text(path, wholetext=not lines).select(F.col("value").alias("v"))
    boxed = [F.from_json(F.col("v"), f"struct<{k}:array<{_ENTRY}>>")[k] for k in ("records", "items", "feedback", "entries")]
    rows = F.from_json(F.col("v"), f"array<{_ENTRY}>")
    each = F.transform(F.filter(F.split("v", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, _ENTRY))
    found = F.when(F.ltrim("v").startswith("["), rows).otherwise(F.coalesce(*boxed, each))
    d = whole.select(F.explode(found).alias("e")).where("e IS NOT NULL")
    label = F.lower(F.trim(F.coalesce("e.expected_label", "e.label", "e.expected", "e.verdict", F.lit(""))))
    d = d.select(F.coalesce("e.path", "e.file").alias("path"), label.alias("expected_label"), F.coalesce("e.notes", F.lit("")).alias("notes"))
    d = d.where((F.trim("path") != "") & F.col("expected_label").isin(*POSITIVE, *NEGATIVE))
    return d.withColumn("label", F.col("expected_label").isin(*POSITIVE).cast("int"))


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, label); quotes inside quoted fields are doubled, as CSV has it."""
    return spark.read.csv(path, header=True, escape='"', schema="path string, label string").where("path IS NOT NULL")


def manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    schema = "samples array<struct<path:string,label:string,generator:string,language:string>>"
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path).select(F.inline("samples"))


def profile(spark: SparkSession, path: str, version: str, lines: bool = False) -> DataFrame:
    """Rows (key, value) of a profile document's numbers; another version has none."""
    schema = "version string, values map<string,double>, weights map<string,double>"
    d = spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path).where(F.col("version") == version)
    return d.select(F.explode(F.coalesce("values", "weights")).alias("key", "value")).where("value IS NOT NULL")
