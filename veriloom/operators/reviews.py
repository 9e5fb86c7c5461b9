"""Review decisions, corrections with their audit trail, review history and re-uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom import constants as K
from veriloom.functions import display as V
from veriloom.functions.extract import to_readings
from veriloom.operators import rules, skew
from veriloom.operators.registry import derived_id, replace_children
from veriloom.sources import tables


def split_known(reviews: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews of known documents, and the rest."""
    ids = documents.select("document_id")
    return reviews.join(ids, "document_id", "left_semi"), reviews.join(ids, "document_id", "left_anti")


def correction_audit(reviews: DataFrame, fields: DataFrame, slice_rows: int = skew.SLICE_ROWS) -> DataFrame:
    """One row per edited known field with the value it replaced.

    The first edit of a field replaces the stored value, each later one the edit before it, by review time and id.
    """
    edits = reviews.filter(F.size("corrections") > 0).select(
        "document_id",
        F.col("id").alias("review_id"),
        "reviewed_at",
        F.explode("corrections").alias("field_name", "corrected_value"),
    )
    edits = edits.withColumn("_edit", F.concat_ws("|", F.col("review_id").cast("string"), "field_name"))
    # Chained before the join, so that only a scan is sampled; a field's edits are all known or all unknown.
    # The previous edit is wrapped so that an edit to null still differs from having no earlier edit.
    chained = skew.ranked(
        edits.withColumn("_new", F.struct(F.col("corrected_value").alias("v"))),
        ["document_id", "field_name"], ["reviewed_at", "review_id"], "_edit", lag={"_before": "_new"}, slice_rows=slice_rows,
    )
    current = fields.select(
        "document_id", "field_name", F.col("id").alias("extracted_field_id"), F.col("field_value").alias("_current")
    )
    chained = chained.join(current, ["document_id", "field_name"])
    previous = F.when(F.col("_before").isNotNull(), F.col("_before.v")).otherwise(F.col("_current"))
    return chained.select(
        derived_id("cor", "review_id", "extracted_field_id").alias("id"),
        "extracted_field_id",
        "review_id",
        "document_id",
        "field_name",
        previous.alias("previous_value"),
        "corrected_value",
        F.col("reviewed_at").alias("created_at"),
    )


def _edits(reviews: DataFrame) -> DataFrame:
    """``(document_id, _edits)``: the latest edit of each field of a document, by field name.

    A row per document, so that fields meet their edits by document and stay where everything else of it is.
    """
    edits = reviews.filter(F.size("corrections") > 0).select(
        "document_id", "id", "reviewed_at", F.explode("corrections").alias("field_name", "_value")
    )
    latest = edits.groupBy("document_id", "field_name").agg(
        F.max_by(F.struct("_value"), F.struct("reviewed_at", "id")).alias("_edit")
    )
    entry = F.struct("field_name", F.col("_edit._value").alias("value"))
    return latest.groupBy("document_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_edits"))


def _edited(field: Column) -> Column:
    return F.coalesce(F.map_contains_key("_edits", field), F.lit(False))


def corrected_fields(fields: DataFrame, reviews: DataFrame) -> DataFrame:
    """Fields after the edits: the latest edit's value, confidence 1.0, source ``reconciled``."""
    edited = _edited(F.col("field_name"))
    joined = fields.join(_edits(reviews), "document_id", "left")
    return joined.withColumns({
        "field_value": F.when(edited, F.element_at("_edits", F.col("field_name"))).otherwise(F.col("field_value")),
        "confidence": F.when(edited, 1.0).otherwise(F.col("confidence")),
        "source": F.when(edited, "reconciled").otherwise(F.col("source")),
    }).select(*fields.columns)


def corrected_values(fields: DataFrame, reviews: DataFrame) -> DataFrame:
    """``(document_id, <six values>)`` after the edits: a document's fields are one row before anything is shuffled."""
    held = fields.select("document_id", "field_name", "field_value")
    joined = to_readings(held).join(_edits(reviews), "document_id", "left")
    values = {f: F.when(F.col(f).isNotNull() & _edited(F.lit(f)), F.element_at("_edits", F.lit(f))).otherwise(F.col(f"{f}.value")) for f in K.FIELDS}
    return joined.select("document_id", *[value.alias(f) for f, value in values.items()])


def reviewed_documents(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Documents with the status their last review leaves them in."""
    last = reviews.groupBy("document_id").agg(F.max_by("action", F.struct("reviewed_at", "id")).alias("_action"))
    status = F.when(F.col("_action") == "flag", "flagged").when(F.col("_action").isNotNull(), "reviewed")
    return (
        documents.join(last, "document_id", "left")
        .withColumn("status", F.coalesce(status, F.col("status")))
        .select(*documents.columns)
    )


def apply(
    documents: DataFrame, fields: DataFrame, reviews: DataFrame, results: DataFrame | None = None, **validation
) -> dict[str, DataFrame]:
    """Apply a batch of reviews.

    Gives the new ``documents`` and ``fields``, the accepted ``reviews``, the ``corrections`` audit rows, the
    ``touched`` document ids, and ``rejects`` for unknown documents. ``validation`` (``as_of`` and other arguments of
    ``rules.revalidate``, kept ``counts`` too) adds ``revalidated``, the results of touched documents with their new
    values, checked against all documents; with ``results`` given as well, these replace theirs there. The status is the review's, whatever the
    rules say.
    """
    accepted, rejects = split_known(reviews, documents)
    changed = corrected_fields(fields, accepted)
    touched = accepted.filter(F.size("corrections") > 0).select("document_id").distinct()
    out = {
        "documents": reviewed_documents(documents, accepted),
        "fields": changed,
        "reviews": accepted,
        "corrections": correction_audit(accepted, fields),
        "touched": touched,
        "rejects": rejects,
    }
    if validation:
        out["touched"] = touched = tables.spool(touched)
        out["revalidated"] = rules.revalidate(touched, rules.records(documents, corrected_values(fields, accepted)), **validation)
        if results is not None:
            out["results"] = replace_children(results, out["revalidated"], touched)
    return out


def history(reviews: DataFrame, id_col: str = "id", slice_rows: int = skew.SLICE_ROWS) -> DataFrame:
    """Reviews numbered per document, oldest first."""
    return skew.ranked(reviews, ["document_id"], ["reviewed_at", id_col], id_col, rank="seq", slice_rows=slice_rows)


def latest_flag(reviews: DataFrame, id_col: str = "id") -> DataFrame:
    """Reason, reviewer and time of each document's last flag."""
    last = F.max_by(F.struct("notes", "reviewer_id", "reviewed_at"), F.struct("reviewed_at", id_col))
    flags = reviews.filter(F.col("action") == "flag").groupBy("document_id").agg(last.alias("f"))
    return flags.select("document_id", F.col("f.notes").alias("reason"), "f.reviewer_id", "f.reviewed_at")


def corrections_report(reviews: DataFrame, documents: DataFrame, id_col: str = "id") -> DataFrame:
    """All reviews with their document's file name; reviews without a document drop. Show newest first."""
    return skew.salted_join(reviews, documents.select("document_id", "filename"), "document_id", id_col, "inner")


def queue_neighbours(
    documents: DataFrame, partition: list[str] | None = None, slice_rows: int = skew.SLICE_ROWS
) -> DataFrame:
    """Position in the review queue with previous and next document.

    Inside each partition (an uploader, a day), or in the whole queue, which is then cut into slices like any other
    large group.
    """
    waiting = documents.filter(F.col("status").isin(K.QUEUE_STATUSES))
    keys = partition or ["_queue"]
    if not partition:
        # One value for every row, but not a literal: joins on a literal key would lose their key.
        waiting = waiting.withColumn("_queue", F.pmod(F.xxhash64("document_id"), F.lit(1)))
    out = skew.ranked(
        waiting, keys, ["uploaded_at", "document_id"], "document_id", rank="position",
        lag={"previous_id": "document_id"}, lead={"next_id": "document_id"}, slice_rows=slice_rows,
    )
    return out if partition else out.drop("_queue")


def next_after_action(documents: DataFrame, partition: str | None = None, slice_rows: int = skew.SLICE_ROWS) -> DataFrame:
    """Document shown after acting on one: the next in the queue, or the first that is left.

    The queue is the whole one, or that of each value of ``partition``.
    """
    neighbours = queue_neighbours(documents, [partition] if partition else None, slice_rows)
    waiting = documents.filter(F.col("status").isin(K.QUEUE_STATUSES))
    if partition is None:
        first = waiting.agg(F.min_by("document_id", F.struct("uploaded_at", "document_id"))).scalar()
        return neighbours.select("document_id", F.coalesce("next_id", F.nullif(first, F.col("document_id"))).alias("advance_to"))
    firsts = waiting.groupBy(partition).agg(F.min_by("document_id", F.struct("uploaded_at", "document_id")).alias("_first"))
    other_first = F.when(F.col("_first") != F.col("document_id"), F.col("_first"))
    return skew.salted_join(neighbours, firsts, partition, "document_id", "left", slice_rows, sample=waiting).select(
        "document_id", F.coalesce("next_id", other_first).alias("advance_to")
    )


# ---- re-uploads --------------------------------------------------------------------------------------------

ATTEMPTS_EXHAUSTED = "attempts_exhausted"


def gate_reuploads(requests: DataFrame, documents: DataFrame, cap: int = K.MAX_REUPLOADS) -> DataFrame:
    """Decide every request: ``attempt`` number if accepted, ``reject_reason`` if not.

    ``requests(request_id, document_id, filename, mime_type, file_size_bytes, requested_at)``. Only acceptable
    files use up attempts. The first ``cap`` of them per document are found by a bounded top-n, which is trimmed
    before the shuffle, so a document with very many requests costs no more than another.
    """
    known = skew.salted_join(
        requests, documents.select("document_id", "reupload_count"), "document_id", "request_id", "left"
    )
    known = known.withColumn(
        "_file_reason", V.reject_reason(F.col("filename"), F.col("mime_type"), F.col("file_size_bytes"))
    )
    order = Window.partitionBy("document_id").orderBy("requested_at", "request_id")
    first = (
        known.filter(F.col("reupload_count").isNotNull() & F.col("_file_reason").isNull())
        .select("document_id", "request_id", "requested_at", "reupload_count")
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= cap)
        .filter(F.col("_rn") + F.col("reupload_count") <= cap)
    )
    per_document = first.groupBy("document_id").agg(
        F.max(F.struct("requested_at", "request_id")).alias("_last"),
        F.max(F.col("_rn") + F.col("reupload_count")).alias("_used"),
        F.collect_list(F.struct("request_id", (F.col("_rn") + F.col("reupload_count")).alias("attempt"))).alias("_accepted"),
    )
    decided = skew.salted_join(known, per_document, "document_id", "request_id", "left", sample=requests)
    here = F.col("request_id")
    mine = F.get(F.filter("_accepted", lambda a: a["request_id"] == here), F.lit(0))
    full = (F.col("reupload_count") >= cap) | F.coalesce(
        (F.col("_used") >= cap) & (F.struct("requested_at", "request_id") > F.col("_last")), F.lit(False)
    )
    reason = (
        F.when(F.col("reupload_count").isNull(), "unknown_document")
        .when(mine.isNotNull(), F.lit(None).cast("string"))
        .when(full, ATTEMPTS_EXHAUSTED)
        .otherwise(F.col("_file_reason"))
    )
    return decided.select(*requests.columns, mine["attempt"].cast("int").alias("attempt"), reason.alias("reject_reason"))


def reupload(
    documents: DataFrame, fields: DataFrame, results: DataFrame, requests: DataFrame, cap: int = K.MAX_REUPLOADS
) -> dict[str, DataFrame]:
    """Replace the files of documents: state reset, fields and results cleared, attempts counted.

    The synthetic flag keeps its first value; the policy result follows the new file name.
    """
    gated = gate_reuploads(requests, documents, cap)
    accepted = gated.filter(F.col("attempt").isNotNull())
    last = accepted.groupBy("document_id").agg(
        F.max_by(F.struct("filename", "mime_type", "file_size_bytes"), "attempt").alias("_new"),
        F.max("attempt").alias("_attempt"),
    )
    hit = F.col("_new").isNotNull()

    def changed(new: Column, column: str) -> Column:
        return F.when(hit, new).otherwise(F.col(column))

    name = F.col("_new.filename")
    updates = {
        "filename": name,
        "status": F.lit("processing"),
        "storage_path": V.storage_key(F.col("document_id"), name),
        "mime_type": F.col("_new.mime_type"),
        "file_size_bytes": F.col("_new.file_size_bytes"),
        "dpdp_status": V.policy_status(name),
        "dpdp_reason": V.policy_reason(name),
        "overall_confidence": F.lit(None).cast("double"),
        "extraction_notes": F.lit(None).cast("string"),
        "reupload_count": F.col("_attempt"),
    }
    renewed = documents.join(last, "document_id", "left").withColumns(
        {c: changed(new, c) for c, new in updates.items() if c in documents.columns}
    )
    keys = accepted.select("document_id").distinct()
    return {
        "documents": renewed.select(*documents.columns),
        "fields": fields.join(keys, "document_id", "left_anti"),
        "results": results.join(keys, "document_id", "left_anti"),
        "rejects": gated.filter(F.col("attempt").isNull()),
    }
