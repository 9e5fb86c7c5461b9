"""Registry reads (queue, search, page, detail) and keyed table maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom import constants as K
from veriloom.functions import display as V
from veriloom.functions import text as X
from veriloom.operators import rules, skew


def derived_id(prefix: str, *parts: Column | str) -> Column:
    """Id from a row's natural key, so that a retried task writes the same one."""
    columns = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.to_json(F.array(*columns)), 256), 1, 12))


# ---- reads -------------------------------------------------------------------------------------------------


def newest_first(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("uploaded_at"), "document_id")


def by_key(configs: DataFrame) -> DataFrame:
    """Rule configurations in the order they are listed."""
    return configs.orderBy("key")


def queue(documents: DataFrame) -> DataFrame:
    """Documents awaiting review; order by ``uploaded_at, document_id`` where the order is shown."""
    return documents.filter(F.col("status").isin(K.QUEUE_STATUSES))


def search(
    documents: DataFrame,
    query: str | None = None,
    bucket: str | None = None,
    script: str | None = None,
    date_from: dt.date | str | None = None,
    date_to: dt.date | str | None = None,
) -> DataFrame:
    """Registry search; a filter left out adds no predicate. Both days are included."""
    if query and query.strip():
        documents = documents.filter(F.contains(F.lower("filename"), F.lit(query.strip().lower())))
    if bucket and bucket != "all":
        documents = documents.filter(F.col("status").isin(K.STATUS_BUCKETS[bucket]))
    if script and script != "all":
        documents = documents.filter(F.col("script_type") == script)
    if date_from:
        documents = documents.filter(F.col("uploaded_at") >= F.lit(str(date_from)).cast("date"))
    if date_to:
        day_after = dt.date.fromisoformat(str(date_to)) + dt.timedelta(days=1)
        documents = documents.filter(F.col("uploaded_at") < F.lit(str(day_after)).cast("date"))
    return documents


def page(
    documents: DataFrame, number: int = 1, size: int = K.PAGE_SIZE, order: list | None = None, slice_rows: int = skew.SLICE_ROWS
) -> DataFrame:
    """One page, newest first, with a serial number. A page past the end gives the last page.

    ``order`` lists ``(column, ascending)`` and ends in a unique column. The first page is a bounded top-n. Any other is
    found by position: the table is cut into ordered slices, their row counts tell which of them hold the page (one,
    or two at a border), and only the rows of those are sorted, however deep the page is. The operator stays lazy.
    """
    order = order or [("uploaded_at", False), ("document_id", True)]
    forward = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]
    columns = documents.columns
    if number <= 1:
        # At most ``size`` rows: gathering them in one row is what the limit has already done.
        packed = documents.orderBy(*forward).limit(size).agg(F.collect_list(F.struct(*columns)).alias("rows"))
        first = packed.select(F.posexplode("rows").alias("_at", "r"))
        return first.select("r.*", (F.col("_at") + 1).cast("bigint").alias("serial"))
    placed = skew.slices_in_order(documents, order, order[-1][0], slice_rows)
    # One row per slice, a bounded number.
    counts = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    spans = counts.select("_slice", F.sum("n").over(upto).alias("end"), F.sum("n").over(Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"), "n")
    skipped = (F.least(F.lit(number), F.ceil(F.col("total") / size)) - 1) * size
    wanted = spans.withColumn("skipped", skipped.cast("bigint")).filter(
        (F.col("end") > F.col("skipped")) & (F.col("end") - F.col("n") < F.col("skipped") + size)
    )
    found = wanted.agg(F.struct(
        F.min("_slice").alias("low"), F.max("_slice").alias("high"), F.min(F.col("end") - F.col("n")).alias("before"),
        F.max("skipped").alias("skipped"),
    )).scalar()
    held = placed.withColumn("_page", found).filter(F.col("_slice").between(F.col("_page.low"), F.col("_page.high")))
    serial = F.col("_page.before") + F.row_number().over(Window.orderBy(*forward))
    numbered = held.withColumn("serial", serial.cast("bigint"))
    on_page = (F.col("serial") > F.col("_page.skipped")) & (F.col("serial") <= F.col("_page.skipped") + size)
    return numbered.filter(on_page).select(*columns, "serial")


def _gathered(rows: DataFrame, name: str, known: list[str], out: str) -> DataFrame:
    """All rows of each document as one array: known names in their order, then the others by name and content."""
    place = F.array_position(F.array(*[F.lit(k) for k in known]), F.col(name))
    entry = F.struct(*[F.col(c) for c in rows.columns if c != "document_id"])
    order = F.struct(F.when(place > 0, place).otherwise(len(known) + 1).alias("at"), F.col(name).alias("name"), entry.alias("entry"))
    grouped = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(order)).alias("_all"))
    return grouped.select("document_id", F.transform("_all", lambda e: e["entry"]).alias(out))


def detail(documents: DataFrame, fields: DataFrame, results: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Documents with their fields and rule results as arrays.

    Each child is reduced to one row per document before it is joined, so the two never multiply. The arrays hold
    every row of the child tables, repeated and unknown names included. ``keys`` limits the documents.
    """
    if keys is not None:
        keys = keys.select("document_id").distinct()
        documents, fields, results = (t.join(keys, "document_id", "left_semi") for t in (documents, fields, results))
    by_field = _gathered(fields, "field_name", K.FIELDS, "fields")
    by_rule = _gathered(results.select("document_id", "rule_name", "result", "message"), "rule_name", K.RULE_ORDER, "validations")
    joined = documents.join(by_field, "document_id", "left").join(by_rule, "document_id", "left")
    empty_fields = F.array().cast(by_field.schema["fields"].dataType)
    empty_rules = F.array().cast(by_rule.schema["validations"].dataType)
    return joined.withColumns({
        "fields": F.coalesce("fields", empty_fields),
        "validations": F.coalesce("validations", empty_rules),
    })


def ready(documents: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Documents whose processing has ended, among ``keys`` if given."""
    if keys is not None:
        documents = documents.join(keys.select("document_id").distinct(), "document_id", "left_semi")
    return documents.filter(F.col("status") != "processing")


def ingest(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New document rows, and refused uploads with the reason.

    ``uploads(document_id, filename, mime_type, file_size_bytes, uploaded_by, uploaded_at)``.
    """
    checked = uploads.withColumn(
        "reject_reason", V.reject_reason(F.col("filename"), F.col("mime_type"), F.col("file_size_bytes"))
    )
    name = F.col("filename")
    accepted = checked.filter(F.col("reject_reason").isNull()).select(
        "document_id",
        "filename",
        F.lit("processing").alias("status"),
        F.lit(K.PROVISIONAL_SCRIPT).alias("script_type"),
        V.is_compliant(name).alias("is_synthetic"),
        V.policy_status(name).alias("dpdp_status"),
        V.policy_reason(name).alias("dpdp_reason"),
        "uploaded_at",
        "uploaded_by",
        F.lit(None).cast("double").alias("overall_confidence"),
        F.lit(None).cast("string").alias("extraction_notes"),
        V.storage_key(F.col("document_id"), name).alias("storage_path"),
        "mime_type",
        "file_size_bytes",
        F.lit(0).alias("reupload_count"),
    )
    return accepted, checked.filter(F.col("reject_reason").isNotNull())


# ---- table maintenance -------------------------------------------------------------------------------------


def replace_children(old: DataFrame, new: DataFrame, keys: DataFrame, key: str = "document_id") -> DataFrame:
    """Children of the given parents replaced by ``new``; those of other parents kept."""
    kept = old.join(keys.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new)


def reconcile(current: DataFrame, wanted: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Both tables matched by key with the operation that turns the first into the second.

    ``op`` is insert, update, delete or keep; value columns are the wanted ones, or the current ones for a delete.
    """
    c = current.select(*keys, F.struct(*values).alias("_have"))
    w = wanted.select(*keys, F.struct(*values).alias("_want"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"_have.{v}").eqNullSafe(F.col(f"_want.{v}"))
    op = (
        F.when(F.col("_have").isNull(), "insert")
        .when(F.col("_want").isNull(), "delete")
        .when(same, "keep")
        .otherwise("update")
    )
    chosen = F.coalesce("_want", "_have")
    return c.join(w, keys, "full_outer").select(*keys, *[chosen[v].alias(v) for v in values], op.alias("op"))


def apply_operations(operations: DataFrame) -> DataFrame:
    """The table a reconcile leads to."""
    return operations.filter("op != 'delete'").drop("op")


def insert_absent(current: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """Current rows untouched, plus default rows whose key is missing."""
    return current.unionByName(defaults.join(current.select(key), key, "left_anti"))


def upsert(current: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_embeddings(current: DataFrame, new: DataFrame) -> DataFrame:
    """One embedding row per document. Blank text writes nothing; a null embedding overwrites an older one."""
    return upsert(current, new.filter(X.strip(F.col("searchable_text")) != ""))


def add_missing(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add absent columns as ``{name: (type, default)}``; columns already there are left as they are."""
    missing = {n: F.lit(value).cast(kind) for n, (kind, value) in defaults.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def merge_evolved(older: DataFrame, newer: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows of two versions of a table; a column one of them lacks takes its default."""
    both = older.unionByName(newer, allowMissingColumns=True)
    return both.withColumns({n: F.coalesce(F.col(n), F.lit(value)) for n, value in defaults.items()})


def drop_orphans(children: DataFrame, parents: DataFrame, key: str = "document_id") -> DataFrame:
    """Children whose parent is gone go too."""
    return children.join(parents.select(key), key, "left_semi")


def check_enumeration(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.withColumn(f"{column}_ok", F.col(column).isin(allowed))


def missing_validations(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Documents past extraction that carry no rule results yet."""
    return queue(documents).join(results.select("document_id").distinct(), "document_id", "left_anti")


def backfill_validations(documents: DataFrame, fields_wide: DataFrame, results: DataFrame, **kwargs) -> DataFrame:
    """Results for documents that should have some and have none, checked against all records."""
    everything = rules.records(documents, fields_wide).select("document_id", "filename", *K.FIELDS)
    return rules.revalidate(missing_validations(documents, results), everything, **kwargs)
