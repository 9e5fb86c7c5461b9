"""Scanned files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import display as V

# Mime type by extension, for files that come without one.
MIME_BY_EXTENSION = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp",
    "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf",
}

# The columns of Spark's binary file source, which a stream has to be told.
SCAN_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def read_scans(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Files under ``path`` with size, guessed mime type and reason for refusal.

    Content is left out unless asked for; it should be read again by path where it is needed and never shuffled.
    Spark's file sources pass over empty files, so an empty upload is refused where its size is known: in ``ingest``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _described(files, with_content)


def watch_scans(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """``read_scans`` as a stream: each batch holds the files that no earlier one had, known by their path.

    The stream's progress is the list of files seen, so a restart lists the folder but takes in new files only. Files
    are not opened.
    """
    reader = spark.readStream.format("binaryFile").schema(SCAN_FILE).option("recursiveFileLookup", "true")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _described(reader.load(path), with_content=False)


def _described(files: DataFrame, with_content: bool) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    mime = F.element_at(F.create_map(*[F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair]), extension)
    return files.select(
        "path",
        name.alias("filename"),
        mime.alias("mime_type"),
        F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("uploaded_at"),
        V.reject_reason(name, mime, F.col("length")).alias("reject_reason"),
        *([F.col("content"), V.is_pdf(mime, F.col("content")).alias("is_pdf")] if with_content else []),
    )


def mark_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Whether each file is a PDF by type or by its first bytes; content goes no further than this projection."""
    return read_scans(spark, path, with_content=True).select("path", "filename", "is_pdf")
