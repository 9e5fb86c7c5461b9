"""Scans taken in as they are dropped into a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veriloom.operators import registry as G
from veriloom.sources.tables import RegistryLog
from veriloom.streaming import verify as SV


def take_in(stream: DataFrame, path: str, checkpoint: str, *, uploaded_by: str, **trigger) -> StreamingQuery:
    """Log each new scan as an accepted document, ready to be read, or as a refused one with its reason.

    ``stream`` comes from ``sources.scans.watch_scans``. A document's id follows from its file's path, so a
    batch that is replayed writes the same rows; ``source_path`` is where readers find the content.
    """
    log = RegistryLog(path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        uploads = batch.select(
            G.derived_id("doc", "path").alias("document_id"), "filename", "mime_type", "file_size_bytes",
            F.lit(uploaded_by).alias("uploaded_by"), "uploaded_at", F.col("path").alias("source_path"),
        )
        accepted, refused = G.ingest(uploads)
        where = uploads.select("document_id", "source_path")
        log.write(refused, "rejects", batch_id)
        log.write(accepted.select("document_id").join(where, "document_id"), "sources", batch_id)
        SV.write_statuses(log, accepted, batch_id)

    return SV.start(stream, handle, checkpoint, trigger)
