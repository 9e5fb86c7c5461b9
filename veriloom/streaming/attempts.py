"""Re-upload attempts counted across micro-batches.

Documents are counted a block of neighbouring ids at a time, so that Python is called per block and not per document; a
block has at most ``1 << BLOCK_BITS`` documents however many there are. Documents whose ids lie far apart have blocks of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom import constants as K
from veriloom.functions import display as V

OUTPUT = "document_id bigint, request_id bigint, attempt int, refused bigint"
BLOCK_BITS = 8
UNSEEN = np.iinfo(np.int32).min


def _counter(cap: int):
    def count(key, chunks, state):
        size = 1 << BLOCK_BITS
        used = np.frombuffer(state.get[0], "<i4").copy() if state.exists else np.full(size, UNSEEN, "<i4")
        seen = np.zeros(size, np.int64)
        at, when, ids = np.zeros(0, np.int64), np.zeros(0, "datetime64[ns]"), np.zeros(0, np.int64)
        for chunk in chunks:
            here = chunk["document_id"].to_numpy() - (key[0] << BLOCK_BITS)
            seen += np.bincount(here, minlength=size)
            new = np.flatnonzero(used[here] == UNSEEN)[::-1]  # of several rows the first one counts
            used[here[new]] = chunk["reupload_count"].to_numpy()[new]
            at = np.concatenate([at, here])
            when = np.concatenate([when, chunk["requested_at"].to_numpy("datetime64[ns]")])
            ids = np.concatenate([ids, chunk["request_id"].to_numpy(np.int64)])
            # Only as many of the earliest requests of a document as it has attempts left are ever held.
            order = np.lexsort((ids, when, at))
            place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
            order = order[place < cap - used[at[order]]]
            at, when, ids = at[order], when[order], ids[order]
        first = np.bincount(at, minlength=size)
        attempt = used[at] + np.arange(len(at)) - np.searchsorted(at, at) + 1
        refused = np.flatnonzero(seen > first)
        used[first > 0] += first[first > 0].astype("<i4")
        state.update((used.tobytes(),))
        yield pd.DataFrame({
            "document_id": (key[0] << BLOCK_BITS) + np.concatenate([at, refused]),
            "request_id": pd.array([*ids.tolist(), *[None] * len(refused)], "Int64"),
            "attempt": pd.array([*attempt.tolist(), *[None] * len(refused)], "Int32"),
            "refused": np.concatenate([np.zeros(len(at), np.int64), (seen - first)[refused]]),
        })

    return count


def gate(stream: DataFrame, cap: int = K.MAX_REUPLOADS) -> DataFrame:
    """Accepted requests with their attempt number, and the number refused per document and batch.

    ``stream(document_id, request_id, requested_at, reupload_count, filename, mime_type, file_size_bytes)``; files that
    would be refused anyway use up no attempt.
    """
    fine = V.reject_reason(F.col("filename"), F.col("mime_type"), F.col("file_size_bytes")).isNull()
    wanted = stream.filter(fine).select("document_id", "request_id", "requested_at", "reupload_count")
    blocks = wanted.withColumn("block", F.shiftright(F.col("document_id").cast("bigint"), BLOCK_BITS))
    return blocks.groupBy("block").applyInPandasWithState(_counter(cap), OUTPUT, "used binary", "append", "NoTimeout")
