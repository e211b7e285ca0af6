"""Options of document processing: their registry, and requests held against it as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, type, default, lowest, highest, allowed values, formats it applies to.
OPTIONS = (
    ("preserveLineBreaks", "BOOLEAN", "true", None, None, None, ("TXT", "PDF", "DOCX")),
    ("includeMetadata", "BOOLEAN", "false", None, None, None, ("PDF", "DOCX")),
    ("ocrEnabled", "BOOLEAN", "false", None, None, None, ("PDF",)),
    ("pdf.split-pages", "BOOLEAN", "false", None, None, None, ("PDF",)),
    ("maxPages", "INTEGER", "0", 0, 10_000, None, ("PDF",)),
    ("pdf.sort-by-position", "BOOLEAN", "false", None, None, None, ("PDF",)),
    ("pdf.enable-auto-space", "BOOLEAN", "true", None, None, None, ("PDF",)),
    ("pdf.suppress-duplicate-overlapping-text", "BOOLEAN", "true", None, None, None, ("PDF",)),
    ("pdf.extract-annotation-text", "BOOLEAN", "true", None, None, None, ("PDF",)),
    ("pdf.extract-bookmarks-text", "BOOLEAN", "true", None, None, None, ("PDF",)),
    ("pdf.extract-acroform-content", "BOOLEAN", "true", None, None, None, ("PDF",)),
    ("pdf.extract-font-names", "BOOLEAN", "false", None, None, None, ("PDF",)),
    ("pdf.extract-inline-images", "BOOLEAN", "false", None, None, None, ("PDF",)),
    ("pdf.extract-unique-inline-images-only", "BOOLEAN", "true", None, None, None, ("PDF",)),
    ("pdf.extract-inline-image-metadata-only", "BOOLEAN", "false", None, None, None, ("PDF",)),
    ("pdf.ocr-strategy", "STRING", "NO_OCR", None, None, ("AUTO", "NO_OCR", "OCR_ONLY", "OCR_AND_TEXT_EXTRACTION"), ("PDF",)),
    ("pdf.ocr-rendering-strategy", "STRING", "NO_TEXT", None, None, ("NO_TEXT", "TEXT_ONLY", "VECTOR_GRAPHICS_ONLY", "ALL"), ("PDF",)),
    ("pdf.ocr-dpi", "INTEGER", "300", 72, 600, None, ("PDF",)),
    ("pdf.ocr-image-format", "STRING", "png", None, None, ("png", "jpeg", "tiff"), ("PDF",)),
    ("ocr.language", "STRING", "eng", None, None, None, ("PDF",)),
    ("ocr.page-segmentation-mode", "STRING", "1", None, None, tuple(map(str, range(14))), ("PDF",)),
    ("ocr.preserve-interword-spacing", "BOOLEAN", "false", None, None, None, ("PDF",)),
    ("ocr.timeout-seconds", "INTEGER", "120", 1, 3600, None, ("PDF",)),
    ("ocr.skip", "BOOLEAN", "true", None, None, None, ("PDF",)),
    ("tika.write-limit", "INTEGER", "-1", -1, 10_000_000, None, ("PDF", "DOCX")),
    ("docxRevisionMode", "STRING", "final", None, None, ("final", "original"), ("DOCX",)),
)


def registry(spark: SparkSession) -> DataFrame:
    rows = [(n, t, d, low, high, list(a) if a else None, list(f)) for n, t, d, low, high, a, f in OPTIONS]
    return spark.createDataFrame(rows, "name string, type string, default string, low long, high long, allowed array<string>, formats array<string>")


def violations(requests: DataFrame) -> DataFrame:
    """document_id, name, problem of every option that does not hold. requests: document_id, format, name, value."""
    joined = requests.join(F.broadcast(registry(requests.sparkSession)), "name", "left")  # 26 rows
    number = F.expr("try_cast(value as bigint)")
    problem = (
        F.when(F.col("type").isNull(), "UNKNOWN").when(~F.array_contains("formats", F.col("format")), "NOT_APPLICABLE")
        .when((F.col("type") == "BOOLEAN") & ~F.coalesce(F.lower("value").isin("true", "false"), F.lit(False)), "TYPE").when((F.col("type") == "INTEGER") & number.isNull(), "TYPE")
        .when((number < F.col("low")) | (number > F.col("high")), "RANGE").when(F.col("allowed").isNotNull() & ~F.coalesce(F.array_contains("allowed", F.col("value")), F.lit(False)), "VALUE")
    )
    return joined.select("document_id", "name", problem.alias("problem")).where("problem is not null")


def effective(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """document_id and options, a map of every applicable option: the requested value, else the default. documents: document_id, format."""
    known = registry(documents.sparkSession).select("name", "default", F.explode("formats").alias("format"))
    own = documents.join(F.broadcast(known), "format")
    asked = requests.select("document_id", "name", "value")
    rows = own.join(asked, ["document_id", "name"], "left").select("document_id", "name", F.coalesce("value", "default").alias("value"))
    return rows.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("options"))
