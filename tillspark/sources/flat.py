"""Flat-record sources with a channel for bad records (A4): CSV and JSON lines bound to a schema.

A record that does not fit its schema is kept as the text it was and goes to the
rejects; the others go on with their columns.  Intake then applies the entity's
rules: names are trimmed and required, empty texts become NULL, and categories
must not exist yet (decided in the order of the lines, see ``edits``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import edits

CORRUPT = "_corrupt"
MALFORMED = "malformed"
MSG_MALFORMED = "Unreadable record"
S = T.StringType()

SUPPLIER_RECORD = T.StructType([T.StructField("name", S), T.StructField("phone", S), T.StructField("notes", S)])
CATEGORY_RECORD = T.StructType([T.StructField("name", S)])


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, S)])


def read_flat(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", **options) -> DataFrame:
    """Records of CSV or JSON-lines files; a record that does not fit keeps its text in ``_corrupt``."""
    reader = spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.options(**options).format(fmt).load(path)


def parse_flat(lines: DataFrame, schema: T.StructType, fmt: str = "csv", col: str = "raw") -> DataFrame:
    """``lines`` with their record's columns and ``_corrupt``: the text of a record that does not fit, else NULL."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"'}
    full = _with_corrupt(schema)
    if fmt == "csv":
        record = F.from_csv(F.col(col), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.fields), options)
    else:
        record = F.from_json(F.col(col), full, options)
    parsed = lines.withColumn("_r", record)
    # a missing line, and JSON that is no object, give no record at all
    lost = F.col("_r").isNull() | F.col(col).isNull()
    bad = F.when(lost, F.coalesce(F.col(col), F.lit(""))).otherwise(F.col(f"_r.{CORRUPT}"))
    return parsed.select(*lines.columns, *[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields], bad.alias(CORRUPT))


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def malformed(parsed: DataFrame) -> DataFrame:
    """(seq, raw, reason, message) of the records that do not fit their schema."""
    return parsed.filter(F.col(CORRUPT).isNotNull()).select(
        "seq", F.col(CORRUPT).alias("raw"), F.lit(MALFORMED).alias("reason"), F.lit(MSG_MALFORMED).alias("message"))


def _supplier_records(lines: DataFrame, fmt: str) -> DataFrame:
    return parse_flat(lines, SUPPLIER_RECORD, fmt).withColumn("name", F.trim("name"))


def supplier_intake(lines: DataFrame, fmt: str = "csv") -> DataFrame:
    """New suppliers from ``(seq, raw)`` lines: trimmed name, empty phone and notes as NULL (A4)."""
    ok = good(_supplier_records(lines, fmt)).filter(F.coalesce("name", F.lit("")) != "")
    return ok.select("seq", "name", F.nullif("phone", F.lit("")).alias("phone"), F.nullif("notes", F.lit("")).alias("notes"))


def supplier_intake_rejects(lines: DataFrame, fmt: str = "csv") -> DataFrame:
    """Unreadable records and those without a name (A4, L1)."""
    records = _supplier_records(lines, fmt)
    unnamed = good(records).filter(F.coalesce("name", F.lit("")) == "").select(
        "seq", "raw", F.lit(edits.MISSING).alias("reason"), F.lit(edits.TABLES["suppliers"].missing).alias("message"))
    return malformed(records).unionByName(unnamed)


def _category_inserts(parsed: DataFrame, first_id: int) -> DataFrame:
    return good(parsed).select("seq", F.lit("insert").alias("op"), (F.col("seq") + first_id).alias("id"), "name", "raw")


def category_intake(lines: DataFrame, categories: DataFrame, fmt: str = "json", first_id: int = 1000) -> DataFrame:
    """New categories from ``(seq, raw)`` lines: trimmed names that neither the table nor an earlier line holds (A4, L3)."""
    judged = edits.judged_edits(categories, _category_inserts(parse_flat(lines, CATEGORY_RECORD, fmt), first_id), "categories")
    return judged.filter("reason IS NULL").select("seq", "id", "name")


def category_intake_rejects(lines: DataFrame, categories: DataFrame, fmt: str = "json", first_id: int = 1000) -> DataFrame:
    """Unreadable records, those without a name, and names that exist (A4, L1, L3)."""
    parsed, rule = parse_flat(lines, CATEGORY_RECORD, fmt), edits.TABLES["categories"]
    judged = edits.judged_edits(categories, _category_inserts(parsed, first_id), "categories")
    refused = judged.filter("reason IS NOT NULL").select(
        "seq", "raw", "reason", F.when(F.col("reason") == edits.MISSING, F.lit(rule.missing)).otherwise(F.lit(rule.duplicate)).alias("message"))
    return malformed(parsed).unionByName(refused)
