"""Registered queries with, where SQL can say the same, the equivalent text for the oracle.

Every query reads whole driver tables through the adapters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom import constants as K
from veriloom import session
from veriloom.functions import display as V
from veriloom.functions import extract as E
from veriloom.functions import model_json as J
from veriloom.functions import scripts as S
from veriloom.functions import text as X
from veriloom.operators import guards, quality, readings, registry, reports, reviews, rules, samplegen, similarity
from veriloom.plans import adapters as A
from veriloom.plans import verify as P
from veriloom.sources import tables
from veriloom.sources.tables import RegistryLog
from veriloom.streaming import attempts
from veriloom.streaming import verify as SV

AS_OF = "2024-06-30"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(body: Query) -> Query:
        QUERIES[name] = body
        if oracle is not None:
            ORACLES[name] = oracle
        return body

    return register


def _text(name: str) -> Column:
    """A number that may be null, shown as text: data frame libraries disagree on null integers."""
    return F.col(name).cast("string").alias(name)


def _run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes."""
    return f"{session.shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# ---- rules -------------------------------------------------------------------------------------------------

_ID_LABELS = "[CASE WHEN coalesce(property_id, '') = '' THEN 'Property ID' END, CASE WHEN coalesce(mutawalli_name, '') = '' THEN 'Mutawalli name' END, CASE WHEN coalesce(survey_number, '') = '' THEN 'Survey number' END]"
_MISSING = f"list_filter({_ID_LABELS}, lambda x: x IS NOT NULL)"
_PARSED = r"""coalesce(
  CASE WHEN regexp_matches(trim(registration_date), '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$') THEN try_strptime(trim(registration_date), '%Y-%m-%d') END,
  CASE WHEN regexp_matches(trim(registration_date), '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$') THEN try_strptime(trim(registration_date), '%d-%m-%Y') END,
  CASE WHEN regexp_matches(trim(registration_date), '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN try_strptime(trim(registration_date), '%d/%m/%Y') END)"""
_RULE_MANDATORY = f"""SELECT document_id, 'mandatory_fields_present' AS rule_name,
  CASE WHEN len(m) = 0 THEN 'pass' ELSE 'fail' END AS result,
  CASE WHEN len(m) = 0 THEN '{rules.ALL_PRESENT}' WHEN len(m) = 1 THEN m[1] || ' could not be extracted.'
       ELSE len(m) || ' mandatory field(s) could not be extracted: ' || array_to_string(m, ', ') || '.' END AS message
  FROM (SELECT document_id, {_MISSING} AS m FROM rec)"""
_RULE_SURVEY = rf"""SELECT document_id, 'survey_number_format' AS rule_name,
  CASE WHEN coalesce(survey_number, '') = '' THEN 'fail'
       WHEN regexp_matches(trim(survey_number), '^\p{{Nd}}{{3,4}}/\p{{Nd}}{{1,2}}(-[A-Za-z])?$') THEN 'pass'
       WHEN regexp_matches(trim(survey_number), '^\p{{Nd}}{{1,2}}/\p{{Nd}}{{1,2}}(-[A-Za-z])?$') THEN 'warning' ELSE 'fail' END AS result,
  CASE WHEN coalesce(survey_number, '') = '' THEN '{rules.SURVEY_EMPTY}'
       WHEN regexp_matches(trim(survey_number), '^\p{{Nd}}{{3,4}}/\p{{Nd}}{{1,2}}(-[A-Za-z])?$') THEN '{rules.SURVEY_OK}'
       WHEN regexp_matches(trim(survey_number), '^\p{{Nd}}{{1,2}}/\p{{Nd}}{{1,2}}(-[A-Za-z])?$') THEN '{rules.SURVEY_SHORT_FORM}'
       ELSE '''' || trim(survey_number) || ''{rules.SURVEY_BAD}' END AS message FROM rec"""
_RULE_DATE = f"""SELECT document_id, 'date_plausibility' AS rule_name,
  CASE WHEN coalesce(registration_date, '') = '' OR d IS NULL OR d > DATE '{AS_OF}' OR d < DATE '1900-01-01' THEN 'fail'
       WHEN d < DATE '1980-01-01' THEN 'warning' ELSE 'pass' END AS result,
  CASE WHEN coalesce(registration_date, '') = '' THEN '{rules.DATE_MISSING}' WHEN d IS NULL THEN '''' || registration_date || ''{rules.DATE_BAD}'
       WHEN d > DATE '{AS_OF}' THEN '{rules.DATE_FUTURE}' WHEN d < DATE '1900-01-01' THEN '{rules.DATE_TOO_EARLY}'
       WHEN d < DATE '1980-01-01' THEN '{rules.DATE_BEFORE_REGISTER}' ELSE '{rules.DATE_OK}' END AS message
  FROM (SELECT *, {_PARSED} AS d FROM rec)"""
_DUPLICATES = """SELECT document_id, property_id, count(*) OVER (PARTITION BY property_id) - 1 AS n_others
  FROM allrec WHERE coalesce(property_id, '') <> ''"""
_RULE_CROSS = f"""SELECT rec.document_id, 'cross_document_consistency' AS rule_name,
  CASE WHEN coalesce(rec.property_id, '') = '' THEN 'warning' WHEN n_others > 0 THEN 'fail' ELSE 'pass' END AS result,
  CASE WHEN coalesce(rec.property_id, '') = '' THEN '{rules.ID_MISSING}'
       WHEN n_others > 0 THEN 'Property ID ' || rec.property_id || ' also appears in ' || n_others || CASE WHEN n_others = 1 THEN ' other document' ELSE ' other documents' END || '{rules.ID_DUPLICATE}'
       ELSE '{rules.ID_UNIQUE}' END AS message FROM rec LEFT JOIN dup ON dup.document_id = rec.document_id"""
_RECORDS = "SELECT d.document_id, d.filename, w.property_id, w.mutawalli_name, w.survey_number, w.registration_date, w.extent, w.village FROM reg_documents d LEFT JOIN reg_fields_wide w USING (document_id)"


def _rules_sql(rec: str = _RECORDS, allrec: str | None = None) -> str:
    """CTEs up to ``results`` for records ``rec``, with duplicates sought among ``allrec``."""
    return (
        A.with_views("reg_documents", "reg_fields_wide")
        + f", rec AS ({rec}), allrec AS ({allrec or 'SELECT * FROM rec'}), dup AS ({_DUPLICATES}), results AS ("
        + " UNION ALL ".join([_RULE_MANDATORY, _RULE_SURVEY, _RULE_DATE, _RULE_CROSS])
        + ") "
    )


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and fields come from the same order rows, so the record needs no join."""
    names = A.SQL["reg_documents"].replace("o_orderkey AS document_id", "o_orderkey AS document_id, o_orderkey, o_custkey, o_orderdate")
    both = A.SQL["reg_fields_wide"].replace("o_orderkey AS document_id", "document_id, filename").replace("{orders}", "{named}")
    return spark.sql(both, named=spark.sql(names, orders=A.table(spark, folder, "orders")))


def _results(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    config = {r: r in only for r in K.RULE_ORDER} if only else None
    return rules.validate(_records(spark, folder), as_of=AS_OF, config=config)


@query("rule_outcome_counts", _rules_sql() + "SELECT rule_name, result, count(*) AS n FROM results GROUP BY 1, 2")
def rule_outcome_counts(spark, folder):
    return reports.rule_outcome_counts(_results(spark, folder))


@query("validation_results_long", _rules_sql() + "SELECT * FROM results WHERE rule_name <> 'survey_number_format'")
def validation_results_long(spark, folder):
    return rules.validate(_records(spark, folder), as_of=AS_OF, config={"survey_number_format": False})


@query("mandatory_fields", _rules_sql() + "SELECT document_id, result, message FROM results WHERE rule_name = 'mandatory_fields_present'")
def mandatory_fields(spark, folder):
    return _results(spark, folder, ["mandatory_fields_present"]).drop("rule_name")


@query("survey_number_format", _rules_sql() + "SELECT document_id, result, message FROM results WHERE rule_name = 'survey_number_format'")
def survey_number_format(spark, folder):
    return _results(spark, folder, ["survey_number_format"]).drop("rule_name")


@query("date_plausibility", _rules_sql() + "SELECT document_id, result, message FROM results WHERE rule_name = 'date_plausibility'")
def date_plausibility(spark, folder):
    return _results(spark, folder, ["date_plausibility"]).drop("rule_name")


@query("duplicate_property_ids", _rules_sql() + "SELECT document_id, property_id, cast(n_others AS bigint) AS n_others FROM dup WHERE n_others > 0")
def duplicate_property_ids(spark, folder):
    return rules.duplicate_members(_records(spark, folder)).select("document_id", "property_id", "n_others")


@query("duplicate_names", _rules_sql() + "SELECT property_id, count(*) AS n_members, md5(string_agg(filename, ', ' ORDER BY filename, document_id)) AS names_hash FROM rec WHERE property_id <> '' GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, folder):
    records = _records(spark, folder)
    named = rules.duplicate_names(records, rules.duplicate_members(records))
    names = F.array_join(F.transform("members", lambda m: m["label"]), ", ")
    return named.select("property_id", F.size("members").cast("bigint").alias("n_members"), F.md5(names).alias("names_hash"))


@query("cross_document_results", _rules_sql() + "SELECT document_id, result, message FROM results WHERE rule_name = 'cross_document_consistency'")
def cross_document_results(spark, folder):
    return rules.cross_document_consistency(_records(spark, folder)).drop("rule_name")


@query("duplicate_texts", "WITH t AS (SELECT doc_id, md5(text) AS text_hash, count(*) OVER (PARTITION BY md5(text)) - 1 AS n_others FROM documents) SELECT doc_id, text_hash, n_others FROM t WHERE n_others > 0")
def duplicate_texts(spark, folder):
    hashed = A.table(spark, folder, "documents").select("doc_id", F.md5("text").alias("text_hash"))
    members = hashed.withColumn("label", F.col("doc_id"))
    return rules.duplicate_members(members, id_col="doc_id", key="text_hash", label="label").select("doc_id", "text_hash", "n_others")


@query("auto_decision", _rules_sql() + "SELECT document_id, count(*) FILTER (result = 'fail') AS fail_count, CASE WHEN count(*) FILTER (result = 'fail') > 0 THEN 'flag' ELSE 'approve' END AS action, CASE WHEN count(*) FILTER (result = 'fail') > 0 THEN 'flagged' ELSE 'reviewed' END AS status FROM results GROUP BY document_id")
def auto_decision(spark, folder):
    return rules.auto_decision(_results(spark, folder))


_TO_VALIDATE = "SELECT d.document_id, d.filename, w.property_id, w.mutawalli_name, w.survey_number, w.registration_date, w.extent, w.village FROM reg_documents d LEFT JOIN (SELECT * FROM reg_fields_wide WHERE extent <> '4.25 ha') w USING (document_id)"


@query(
    "validate_missing_documents",
    _rules_sql(
        f"SELECT a.* FROM ({_TO_VALIDATE}) a JOIN reg_documents d USING (document_id) WHERE d.status IN ('extracted', 'validated') AND d.uploaded_at >= DATE '1998-01-01'",
        _TO_VALIDATE,
    ) + "SELECT * FROM results",
)
def validate_missing_documents(spark, folder):
    documents, wide = A.view(spark, folder, "reg_documents"), A.view(spark, folder, "reg_fields_wide")
    # Results exist for earlier uploads; documents with one extent have lost their fields.
    existing = documents.filter(F.col("uploaded_at") < F.lit("1998-01-01").cast("date")).select("document_id")
    return registry.backfill_validations(documents, wide.filter("extent != '4.25 ha'"), existing, as_of=AS_OF)


@query("advance_status", _rules_sql() + "SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'extracted' THEN 'validated' ELSE status END AS status FROM reg_documents) GROUP BY 1")
def advance_status(spark, folder):
    documents = A.view(spark, folder, "reg_documents")
    results = _results(spark, folder, ["mandatory_fields_present"])
    return rules.advance_status(documents, results).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- registry reads ----------------------------------------------------------------------------------------


@query("review_queue", A.with_views("reg_documents") + "SELECT document_id, filename, status, uploaded_at FROM reg_documents WHERE status IN ('extracted', 'validated')")
def review_queue(spark, folder):
    return registry.queue(A.view(spark, folder, "reg_documents")).select("document_id", "filename", "status", "uploaded_at")


@query("registry_search", A.with_views("reg_documents") + "SELECT document_id, filename, status FROM reg_documents WHERE contains(lower(filename), 'scan') AND status IN ('uploaded', 'processing', 'extracted', 'validated') AND script_type = 'urdu_nastaliq' AND uploaded_at >= DATE '1995-01-01' AND uploaded_at < DATE '1999-01-01'")
def registry_search(spark, folder):
    documents = A.view(spark, folder, "reg_documents")
    found = registry.search(documents, " SCAN ", "pending", "urdu_nastaliq", "1995-01-01", "1998-12-31")
    return found.select("document_id", "filename", "status")


_PAGE_ORDER = "row_number() OVER (ORDER BY uploaded_at DESC, document_id)"


@query("registry_page", A.with_views("reg_documents") + f"SELECT document_id, filename, serial FROM (SELECT document_id, filename, {_PAGE_ORDER} AS serial FROM reg_documents) WHERE serial BETWEEN 21 AND 30")
def registry_page(spark, folder):
    return registry.page(A.view(spark, folder, "reg_documents"), 3).select("document_id", "filename", "serial")


@query("registry_page_past_end", A.with_views("reg_documents") + f", n AS (SELECT document_id, filename, {_PAGE_ORDER} AS serial, count(*) OVER () AS total FROM reg_documents WHERE status = 'flagged') SELECT document_id, filename, serial FROM n WHERE serial > (ceil(total / 10.0) - 1) * 10")
def registry_page_past_end(spark, folder):
    flagged = A.view(spark, folder, "reg_documents").filter("status = 'flagged'")
    return registry.page(flagged, 10_000_000).select("document_id", "filename", "serial")


@query(
    "record_detail_counts",
    _rules_sql().replace("WITH reg_documents", "WITH reg_documents").rstrip()
    + """, reg_fields_long AS (""" + A.DUCK_SQL["reg_fields_long"] + """), f AS (SELECT document_id, count(*) AS n_fields FROM reg_fields_long WHERE field_value IS NOT NULL GROUP BY 1),
    v AS (SELECT document_id, string_agg(rule_name || '=' || result, ' ' ORDER BY list_position(['mandatory_fields_present', 'survey_number_format', 'date_plausibility', 'cross_document_consistency'], rule_name)) AS verdicts FROM results GROUP BY 1)
    SELECT d.document_id, coalesce(n_fields, 0) AS n_fields, coalesce(verdicts, '') AS verdicts FROM reg_documents d LEFT JOIN f USING (document_id) LEFT JOIN v USING (document_id)""",
)
def record_detail_counts(spark, folder):
    documents = A.view(spark, folder, "reg_documents").select("document_id")
    detail = registry.detail(documents, A.view(spark, folder, "reg_fields_long").drop("field_no"), _results(spark, folder))
    filled = F.filter("fields", lambda f: f["field_value"].isNotNull())
    verdicts = F.transform("validations", lambda v: F.concat(v["rule_name"], F.lit("="), v["result"]))
    return detail.select(
        "document_id", F.size(filled).cast("bigint").alias("n_fields"), F.array_join(verdicts, " ").alias("verdicts")
    )


_ACCEPTED = """(coalesce(filename, '') <> '' AND (coalesce(mime_type, '') IN ('image/png', 'image/jpeg', 'image/webp', 'image/tiff', 'application/pdf')
  OR regexp_matches(lower(filename), '\\.(png|jpg|jpeg|webp|tif|tiff|pdf)$')))"""
_REASON = f"CASE WHEN NOT {_ACCEPTED} THEN 'unsupported_type' WHEN file_size_bytes > 26214400 THEN 'too_large' WHEN file_size_bytes = 0 THEN 'empty' END"


@query(
    "ingest_check",
    A.with_views("reg_uploads")
    + f""", r AS (SELECT *, {_REASON} AS reject_reason, lower(regexp_extract(filename, '[^/](\\.[^./]+)$', 1)) AS ext,
      regexp_matches(filename, '(?i)synthetic|sample|demo|template|test') AS is_synthetic FROM reg_uploads)
    SELECT document_id, reject_reason, is_synthetic, CASE WHEN is_synthetic THEN 'compliant' ELSE 'needs_review' END AS dpdp_status,
      cast(document_id AS string) || CASE WHEN length(ext) <= 8 THEN ext ELSE '' END AS storage_path FROM r""",
)
def ingest_check(spark, folder):
    accepted, refused = registry.ingest(A.view(spark, folder, "reg_uploads"))
    name = F.col("filename")
    refused = refused.select(
        "document_id", "reject_reason", V.is_compliant(name).alias("is_synthetic"), V.policy_status(name).alias("dpdp_status"),
        V.storage_key(F.col("document_id"), name).alias("storage_path"),
    )
    kept = accepted.select(
        "document_id", F.lit(None).cast("string").alias("reject_reason"), "is_synthetic", "dpdp_status", "storage_path"
    )
    return kept.unionByName(refused)


def _name_hint_sql(column: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(lower({column}), '(^|[^a-z])({'|'.join(codes)})([^a-z]|$)') THEN '{script}'"
        for script, codes in K.FILENAME_CODES
    )
    return f"CASE {cases} END"


@query(
    "filename_script_hint",
    A.with_views("reg_documents")
    + f"SELECT 'document' AS kind, document_id AS id, {_name_hint_sql('filename')} AS hint FROM reg_documents UNION ALL SELECT 'page', page_id, {_name_hint_sql('url')} FROM pages",
)
def filename_script_hint(spark, folder):
    documents = A.view(spark, folder, "reg_documents").select(
        F.lit("document").alias("kind"), F.col("document_id").alias("id"), S.from_filename(F.col("filename")).alias("hint")
    )
    pages = A.table(spark, folder, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), S.from_filename(F.col("url")).alias("hint")
    )
    return documents.unionByName(pages)


@query(
    "attempts_and_display",
    A.with_views("reg_documents", "reg_uploads")
    + """SELECT document_id, cast(greatest(0, 3 - reupload_count) AS int) AS attempts_left,
      CASE WHEN file_size_bytes < 1024 THEN file_size_bytes || ' B' WHEN file_size_bytes < 1048576 THEN printf('%.1f KB', file_size_bytes / 1024.0) ELSE printf('%.1f MB', file_size_bytes / 1048576.0) END AS shown_size,
      coalesce(cast(floor(overall_confidence * 100 + 0.5) AS bigint) || '%', '—') AS shown_confidence,
      CASE WHEN overall_confidence >= 0.9 THEN 'high' WHEN overall_confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band,
      CASE WHEN status IN ('reviewed', 'approved') THEN 'approved' WHEN status = 'flagged' THEN 'flagged' ELSE 'pending' END AS bucket,
      CASE status WHEN 'uploaded' THEN 'Uploaded' WHEN 'processing' THEN 'Processing' WHEN 'flagged' THEN 'Flagged' WHEN 'extracted' THEN 'Awaiting review' WHEN 'validated' THEN 'Awaiting review' ELSE 'Accepted' END AS label
      FROM reg_documents JOIN reg_uploads USING (document_id)""",
)
def attempts_and_display(spark, folder):
    documents = A.view(spark, folder, "reg_documents")
    sizes = A.view(spark, folder, "reg_uploads").select("document_id", "file_size_bytes")
    c = F.col("overall_confidence")
    return documents.join(sizes, "document_id").select(
        "document_id",
        V.reuploads_left(F.col("reupload_count")).alias("attempts_left"),
        V.format_bytes(F.col("file_size_bytes")).alias("shown_size"),
        V.whole_percent(c).alias("shown_confidence"),
        V.header_band(c).alias("band"),
        V.status_bucket(F.col("status")).alias("bucket"),
        V.status_label(F.col("status")).alias("label"),
    )


# ---- reports -----------------------------------------------------------------------------------------------


@query("status_breakdown", A.with_views("reg_documents") + "SELECT status, count(*) AS count FROM reg_documents GROUP BY 1")
def status_breakdown(spark, folder):
    return reports.status_breakdown(A.view(spark, folder, "reg_documents"))


@query("confidence_bands", A.with_views("reg_documents") + "SELECT band, count(c) AS count FROM (VALUES ('high'), ('medium'), ('low')) b(band) LEFT JOIN (SELECT overall_confidence AS c FROM reg_documents WHERE overall_confidence IS NOT NULL) d ON band = CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END GROUP BY 1")
def confidence_bands(spark, folder):
    return reports.confidence_bands(A.view(spark, folder, "reg_documents"))


@query(
    "throughput",
    A.with_views("reg_documents", "reg_reviews")
    + """, a AS (SELECT cast(round_even(avg(duration_seconds), 0) AS bigint) AS s FROM reg_reviews WHERE action IN ('approve', 'correct'))
    SELECT cast(coalesce(nullif(round_even(3600 / nullif(s, 0), 0), 0), 14) AS bigint) AS documents_per_hour, 6 AS manual_baseline_per_hour,
      (SELECT round(coalesce(count(*) FILTER (is_synthetic AND status IN ('flagged', 'reviewed')) / nullif(count(*) FILTER (is_synthetic), 0), 0.9), 9) FROM reg_documents) AS seeded_error_catch_rate,
      coalesce(nullif(s, 0), 95) AS avg_review_seconds FROM a""",
)
def throughput(spark, folder):
    out = reports.throughput(A.view(spark, folder, "reg_reviews"), A.view(spark, folder, "reg_documents"))
    return out.withColumn("seeded_error_catch_rate", F.round("seeded_error_catch_rate", 9))


@query(
    "dashboard_stats",
    A.with_views("reg_documents", "reg_reviews")
    + """SELECT count(*) FILTER (status IN ('extracted', 'validated')) AS pending_review,
      (SELECT count(*) FROM reg_reviews WHERE action IN ('approve', 'correct') AND cast(reviewed_at AS date) = DATE '2024-01-15') AS approved_today,
      count(*) FILTER (status = 'flagged') AS flagged, round(avg(overall_confidence), 9) AS avg_confidence FROM reg_documents""",
)
def dashboard_stats(spark, folder):
    out = reports.dashboard(A.view(spark, folder, "reg_documents"), A.view(spark, folder, "reg_reviews"), "2024-01-15")
    return out.withColumn("avg_confidence", F.round("avg_confidence", 9))


@query("corrections_history", A.with_views("reg_documents", "reg_reviews") + "SELECT review_id, document_id, filename, reviewer_id, action, notes, reviewed_at, cast(duration_seconds AS string) AS duration_seconds FROM reg_reviews JOIN reg_documents USING (document_id)")
def corrections_history(spark, folder):
    joined = reviews.corrections_report(
        A.view(spark, folder, "reg_reviews"), A.view(spark, folder, "reg_documents"), "review_id"
    )
    return joined.select("review_id", "document_id", "filename", "reviewer_id", "action", "notes", "reviewed_at", _text("duration_seconds"))


@query("latest_flag_reason", A.with_views("reg_reviews") + "SELECT document_id, notes AS reason, reviewer_id, reviewed_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY reviewed_at DESC, review_id DESC) AS rn FROM reg_reviews WHERE action = 'flag') WHERE rn = 1")
def latest_flag_reason(spark, folder):
    return reviews.latest_flag(A.view(spark, folder, "reg_reviews"), "review_id")


@query("review_history", A.with_views("reg_reviews") + "SELECT document_id, review_id, action, row_number() OVER (PARTITION BY document_id ORDER BY reviewed_at, review_id) AS seq FROM reg_reviews")
def review_history(spark, folder):
    return reviews.history(A.view(spark, folder, "reg_reviews"), "review_id").select("document_id", "review_id", "action", "seq")


@query(
    "queue_neighbours",
    A.with_views("reg_documents")
    + """SELECT document_id, uploaded_by, row_number() OVER w AS position, cast(lag(document_id) OVER w AS string) AS previous_id, cast(lead(document_id) OVER w AS string) AS next_id
    FROM reg_documents WHERE status IN ('extracted', 'validated') WINDOW w AS (PARTITION BY uploaded_by ORDER BY uploaded_at, document_id)""",
)
def queue_neighbours(spark, folder):
    found = reviews.queue_neighbours(A.view(spark, folder, "reg_documents"), ["uploaded_by"])
    return found.select("document_id", "uploaded_by", "position", _text("previous_id"), _text("next_id"))


@query(
    "queue_positions",
    A.with_views("reg_documents")
    + """SELECT document_id, row_number() OVER w AS position, cast(lag(document_id) OVER w AS string) AS previous_id, cast(lead(document_id) OVER w AS string) AS next_id
    FROM reg_documents WHERE status IN ('extracted', 'validated') WINDOW w AS (ORDER BY uploaded_at, document_id)""",
)
def queue_positions(spark, folder):
    found = reviews.queue_neighbours(A.view(spark, folder, "reg_documents"))
    return found.select("document_id", "position", _text("previous_id"), _text("next_id"))


@query(
    "next_after_action",
    A.with_views("reg_documents")
    + """SELECT document_id, cast(coalesce(lead(document_id) OVER w, CASE WHEN first_value(document_id) OVER w <> document_id THEN first_value(document_id) OVER w END) AS string) AS advance_to
    FROM reg_documents WHERE status IN ('extracted', 'validated') WINDOW w AS (PARTITION BY uploaded_by ORDER BY uploaded_at, document_id)""",
)
def next_after_action(spark, folder):
    found = reviews.next_after_action(A.view(spark, folder, "reg_documents"), "uploaded_by")
    return found.select("document_id", _text("advance_to"))


@query(
    "next_after_action_whole_queue",
    A.with_views("reg_documents")
    + """SELECT document_id, cast(coalesce(lead(document_id) OVER w, CASE WHEN first_value(document_id) OVER w <> document_id THEN first_value(document_id) OVER w END) AS string) AS advance_to
    FROM reg_documents WHERE status IN ('extracted', 'validated') WINDOW w AS (ORDER BY uploaded_at, document_id)""",
)
def next_after_action_whole_queue(spark, folder):
    return reviews.next_after_action(A.view(spark, folder, "reg_documents")).select("document_id", _text("advance_to"))


# ---- readings and text -------------------------------------------------------------------------------------


@query(
    "select_reading",
    A.with_views("reg_readings")
    + """, g AS (SELECT document_id, max(confidence) FILTER (priority = 1) AS pc, max(confidence) FILTER (priority = 2) AS sc, max(confidence) FILTER (priority = 3) AS lc,
      coalesce(bool_or(coalesce(text, '') <> '' AND error IS NULL) FILTER (priority = 1), false) AS po, coalesce(bool_or(coalesce(text, '') <> '' AND error IS NULL) FILTER (priority = 2), false) AS so,
      coalesce(bool_or(coalesce(text, '') <> '' AND error IS NULL) FILTER (priority = 3), false) AS lo FROM reg_readings GROUP BY 1),
    w AS (SELECT document_id, po OR so OR lo AS ok, CASE WHEN so AND (NOT po OR (pc < 0.6 AND sc > pc)) THEN 2 WHEN po THEN 1 ELSE 3 END AS win FROM g)
    SELECT w.document_id, r.engine, r.confidence, w.ok, md5(coalesce(r.text, '')) AS text_hash FROM w JOIN reg_readings r ON r.document_id = w.document_id AND r.priority = w.win""",
)
def select_reading(spark, folder):
    chosen = readings.select_reading(A.view(spark, folder, "reg_readings"))
    return chosen.select("document_id", "engine", "confidence", "ok", F.md5("text").alias("text_hash"))


@query(
    "read_confidence_proxy",
    r"""WITH c AS (SELECT doc_id, length(text) AS n, length(text) - length(regexp_replace(text, '\p{L}+', '', 'g')) AS letters,
      length(text) - length(regexp_replace(text, '[A-Za-z]+', '', 'g')) AS latin FROM documents)
    SELECT doc_id, round_even(least(0.98, 0.55 * CASE WHEN letters > 0 THEN latin / letters ELSE 0 END + 0.30 * ((doc_id % 4 + 1) / 4) + 0.15 * CASE WHEN n >= 40 THEN 1 ELSE greatest(0.5, n / 40) END), 4) AS confidence FROM c""",
)
def read_confidence_proxy(spark, folder):
    documents = A.table(spark, folder, "documents")
    score = S.read_confidence(F.col("text"), F.lit("en-IN"), F.col("doc_id") % 4 + 1, F.lit(4))
    return documents.select("doc_id", score.alias("confidence"))


def _native_union(spark: SparkSession, folder: str) -> DataFrame:
    """Latin texts, native names from the derived fields, and native lines led by each document's number."""
    texts = A.table(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    wide = A.view(spark, folder, "reg_fields_wide")
    line = F.concat_ws(
        " ", "village", "mutawalli_name",
        F.element_at(F.array(*[F.lit(t) for t in _TAILS]), (F.col("document_id") % len(_TAILS) + 1).cast("int")),
    )
    return texts.unionByName(wide.select(F.concat(F.lit("w"), "document_id").alias("id"), line.alias("text")))


_TAILS = ["", "यहाँ में है और", "येथे आहे आणि", "तत्र अस्ति", "सोऽहम्", "देवः रामः", "ہے", "है"]
_COUNT_SQL = lambda markers: " + ".join(f"(length(t) - length(replace(t, '{m}', ''))) / {len(m)}" for m in markers)


@query(
    "detect_script",
    A.with_views("reg_fields_wide")
    + f""", raw AS (SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'w' || document_id,
       concat_ws(' ', village, mutawalli_name, {_TAILS!r}[cast(document_id % {len(_TAILS)} AS int) + 1]) FROM reg_fields_wide),
    c AS (SELECT *, length(regexp_replace(t, '[^\\x{{0900}}-\\x{{097F}}]+', '', 'g')) AS d, length(regexp_replace(t, '[^\\x{{0600}}-\\x{{06FF}}\\x{{FB50}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFF}}]+', '', 'g')) AS a,
      length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS l FROM raw),
    s AS (SELECT *, CASE WHEN d >= a AND d >= l AND d > 0 THEN {_COUNT_SQL(K.MARATHI_MARKERS)} END AS m, CASE WHEN d >= a AND d >= l AND d > 0 THEN {_COUNT_SQL(K.HINDI_MARKERS)} END AS h,
      CASE WHEN d >= a AND d >= l AND d > 0 THEN {_COUNT_SQL(K.SANSKRIT_MARKERS)} END AS k, list_filter(regexp_split_to_array(t, '[\\s।॥,.;:()\\-]+'), lambda w: w <> '') AS ws FROM c)
    SELECT id, CASE WHEN t = '' OR greatest(d, a, l) < 1 THEN NULL
      WHEN d >= a AND d >= l THEN CASE WHEN greatest(m, h, k) > 0 THEN CASE WHEN m >= h AND m >= k THEN 'marathi_devanagari' WHEN h >= k THEN 'hindi_devanagari' ELSE 'sanskrit_devanagari' END
        WHEN contains(t, 'ऽ') THEN 'sanskrit_devanagari'
        WHEN len(ws) > 0 AND len(list_filter(ws, lambda w: suffix(w, 'ः'))) >= 0.15 * len(ws) THEN 'sanskrit_devanagari' END
      WHEN a >= l THEN 'urdu_nastaliq' ELSE 'english_latin' END AS script FROM s""",
)
def detect_script(spark, folder):
    return _native_union(spark, folder).select("id", S.detect(F.col("text")).alias("script"))


_WESTERN_SQL = "translate({0}, '०१२३४५६७८९٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '012345678901234567890123456789')"


@query(
    "indic_digits",
    A.with_views("reg_fields_wide")
    + f"SELECT document_id, CASE WHEN {_WESTERN_SQL.format('survey_number')} <> survey_number THEN {_WESTERN_SQL.format('survey_number')} END AS western, translate(survey_number, '०१२३४५६७८९۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') AS for_patterns FROM reg_fields_wide",
)
def indic_digits(spark, folder):
    s = F.col("survey_number")
    return A.view(spark, folder, "reg_fields_wide").select(
        "document_id", X.western_or_null(s).alias("western"), X.extraction_digits(s).alias("for_patterns")
    )


def _readings_from_wide(wide: DataFrame, confidence: Callable[[int], Column]) -> DataFrame:
    columns = {
        f: F.struct(
            F.col(f).alias("value"), F.lit(None).cast("string").alias("value_en"), confidence(i + 1).alias("confidence"),
            F.lit("mapper").alias("source"),
        )
        for i, f in enumerate(K.FIELDS)
    }
    return wide.withColumns(columns)


_LATIN = "regexp_matches({v}, '[A-Za-z]')"
_DEVA = "regexp_matches({v}, '[\\x{{0900}}-\\x{{097F}}]')"
_ARAB = "regexp_matches({v}, '[\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}]')"


def _moved_sql(field: str) -> str:
    latin, deva, arab = (t.format(v=field) for t in (_LATIN, _DEVA, _ARAB))
    return (
        f"(coalesce({field}, '') <> '' AND ((script_type = 'urdu_nastaliq' AND (({latin} AND NOT {arab}) OR {deva}))"
        f" OR (script_type LIKE '%devanagari' AND (({latin} AND NOT {deva}) OR {arab}))))"
    )


@query(
    "transliteration_guard",
    A.with_views("reg_documents", "reg_fields_wide")
    + f"""SELECT document_id, CASE WHEN NOT {_moved_sql('mutawalli_name')} THEN mutawalli_name END AS name, CASE WHEN {_moved_sql('mutawalli_name')} THEN mutawalli_name END AS name_en,
      CASE WHEN {_moved_sql('mutawalli_name')} THEN least(0.9, 0.2) ELSE 0.9 END AS name_confidence,
      CASE WHEN NOT {_moved_sql('village')} THEN village END AS village, CASE WHEN {_moved_sql('village')} THEN village END AS village_en,
      CASE WHEN NOT (script_type = 'urdu_nastaliq' AND {_DEVA.format(v='survey_number')}) OR survey_number IS NULL THEN survey_number END AS survey_number,
      CASE WHEN script_type = 'urdu_nastaliq' AND {_DEVA.format(v='survey_number')} THEN survey_number
           WHEN script_type <> 'english_latin' AND {_WESTERN_SQL.format('survey_number')} <> survey_number THEN {_WESTERN_SQL.format('survey_number')} END AS survey_en
      FROM reg_fields_wide JOIN reg_documents USING (document_id)""".replace("{{", "{").replace("}}", "}"),
)
def transliteration_guard(spark, folder):
    wide = _readings_from_wide(A.view(spark, folder, "reg_fields_wide"), lambda n: F.lit(0.9))
    scripts = A.view(spark, folder, "reg_documents").select("document_id", "script_type")
    ready = wide.join(scripts, "document_id").withColumn("notes", F.array().cast("array<string>"))
    done = guards.finish(ready, self_check=False)
    return done.select(
        "document_id", F.col("mutawalli_name.value").alias("name"), F.col("mutawalli_name.value_en").alias("name_en"),
        F.col("mutawalli_name.confidence").alias("name_confidence"), F.col("village.value").alias("village"),
        F.col("village.value_en").alias("village_en"), F.col("survey_number.value").alias("survey_number"),
        F.col("survey_number.value_en").alias("survey_en"),
    )


@query(
    "gap_fill_and_confidence",
    A.with_views("reg_scored")
    + """, b AS (SELECT *, coalesce(confidence < 0.4 AND second_confidence > confidence, false) AS better FROM reg_scored)
    SELECT document_id, count(*) FILTER (better) AS n_filled, round(sum(CASE WHEN better THEN second_confidence ELSE confidence END) / 6, 3) AS overall_confidence FROM b GROUP BY 1""",
)
def gap_fill_and_confidence(spark, folder):
    wide = A.view(spark, folder, "reg_fields_wide")
    key = F.col("document_id")
    first = _readings_from_wide(wide, lambda n: ((key * 7 + n * 13) % 101).cast("double") / 100)
    second = _readings_from_wide(wide.filter("document_id % 4 != 3"), lambda n: ((key * 11 + n * 29) % 101).cast("double") / 100)
    second = second.withColumns({f: F.col(f).withField("source", F.lit("second")) for f in K.FIELDS})
    ready = first.withColumn("notes", F.array().cast("array<string>"))
    done = guards.with_overall_confidence(guards.fill_gaps(ready, second))
    filled = F.size(F.filter(F.array(*[F.col(f"{f}.source") for f in K.FIELDS]), lambda s: s == "second"))
    return done.select("document_id", filled.cast("bigint").alias("n_filled"), F.round("overall_confidence", 3).alias("overall_confidence"))


@query(
    "searchable_text",
    A.with_views("reg_fields_wide")
    + f"""SELECT document_id, concat_ws(chr(10), {', '.join(f"'{label}: ' || nullif(trim({'coalesce(' + _WESTERN_SQL.format(f) + ', ' + f + ')' if f == 'survey_number' else f}), '')" for f, label in K.SEARCH_LABELS)}) AS searchable_text FROM reg_fields_wide""",
)
def searchable_text(spark, folder):
    wide = A.view(spark, folder, "reg_fields_wide")
    none = F.lit(None).cast("string")
    fields = {f: (F.col(f), X.western_or_null(F.col(f)) if f == "survey_number" else none) for f in K.FIELDS}
    return wide.select("document_id", similarity.searchable_text(fields).alias("searchable_text"))


_PAGE_LABELS = [
    ("property_id", "property id: "), ("mutawalli_name", "mutawalli: "), ("survey_number", "survey no: "),
    ("registration_date", "registration date: "), ("extent", "extent: "), ("village", "village: "),
]


def _rendered(wide: DataFrame) -> DataFrame:
    lines = [F.concat(F.lit(label), F.col(f)) for f, label in _PAGE_LABELS]
    return wide.select("document_id", F.concat_ws("\n", F.lit("register of records"), *lines).alias("text"))


_SURVEY_DIGITS = "translate(trim(survey_number), '०१२३४५६७८९', '0123456789')"
_SLASHED = "(registration_date LIKE '__/__/____')"
_HAS_SURVEY = f"coalesce(regexp_matches({_SURVEY_DIGITS}, '^[0-9]+/[0-9]+(-A)?$'), false)"
_EXTRACTED = f"""SELECT document_id,
  property_id, CASE WHEN property_id IS NULL THEN 0.15 ELSE 0.97 END AS property_confidence,
  mutawalli_name, CASE WHEN mutawalli_name IS NULL THEN 0.15 ELSE 0.6 END AS name_confidence,
  CASE WHEN {_HAS_SURVEY} THEN {_SURVEY_DIGITS} WHEN coalesce({_SLASHED}, false) THEN substring(registration_date, 1, 5) ELSE trim(survey_number) END AS survey_number,
  CASE WHEN ({_HAS_SURVEY} OR coalesce({_SLASHED}, false)) THEN CASE WHEN survey_number IS NULL THEN 0.75 ELSE 0.9 END WHEN survey_number IS NULL THEN 0.15 ELSE 0.5 END AS survey_confidence,
  CASE WHEN regexp_matches(registration_date, '^[0-9]{{2}}[-/]') THEN substring(registration_date, 7, 4) || '-' || substring(registration_date, 4, 2) || '-' || substring(registration_date, 1, 2) ELSE registration_date END AS registration_date,
  CASE WHEN registration_date IS NULL THEN 0.15 ELSE 0.87 END AS date_confidence,
  extent, 0.93 AS extent_confidence, village, 0.6 AS village_confidence FROM reg_fields_wide"""


@query("extract_fields", A.with_views("reg_fields_wide") + _EXTRACTED)
def extract_fields(spark, folder):
    read = E.with_readings(_rendered(A.view(spark, folder, "reg_fields_wide")), "text", label_chars=K.LABEL_VALUE_CHARS)
    short = {
        "property_id": "property", "mutawalli_name": "name", "survey_number": "survey", "registration_date": "date",
        "extent": "extent", "village": "village",
    }
    columns = [F.col("document_id")]
    for f, name in short.items():
        columns += [F.col(f"{f}.value").alias(f), F.col(f"{f}.confidence").alias(f"{name}_confidence")]
    return read.select(*columns)


@query("extract_from_documents")
def extract_from_documents(spark, folder):
    texts = A.table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "text")
    found = E.extract_fields(texts)
    return found.groupBy("field_name").agg(
        F.count("field_value").alias("found"), F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")
    )


@query("strip_markup")
def strip_markup(spark, folder):
    pages = A.table(spark, folder, "pages")
    plain = pages.select("page_id", X.strip_markup(F.col("html")).alias("text"))
    return plain.select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_hash"))


_JSON_SQL = "to_json({" + ", ".join(f"'{f}': {f}" for f in K.FIELDS) + "})"


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """A model answer per record: bare, fenced, or with confidences that are numbers, text, true or false, by record number."""
    wide = A.view(spark, folder, "reg_fields_wide")
    plain = F.to_json(F.struct(*K.FIELDS))
    key = F.col("document_id")
    hundredths = F.concat((key % 150).cast("string"), F.lit("e-2"))
    given = F.when(key % 4 == 0, hundredths).when(key % 4 == 1, '"0.9"').when(key % 4 == 2, "true").otherwise("false")
    confidence = F.concat(F.lit(',"note":{"village":"other"},"confidence":{"village":'), given, F.lit("}}"))
    graded = F.concat(F.expr("substring(plain, 1, length(plain) - 1)"), confidence)
    return wide.withColumn("plain", plain).select(
        "document_id",
        F.when(key % 3 == 0, F.col("plain")).when(key % 3 == 1, F.concat(F.lit("```json\n"), F.col("plain"), F.lit("\n```"))).otherwise(graded).alias("raw"),
    )


@query(
    "model_json_fields",
    A.with_views("reg_fields_long")
    + """SELECT document_id, field_name, nullif(trim(field_value), '') AS field_value, CASE WHEN field_value IS NULL THEN 0.0 ELSE 0.9 END AS flat_confidence,
      CASE WHEN document_id % 3 <> 1 AND trim(field_value) <> '' THEN field_value END AS graded_value,
      CASE WHEN document_id % 3 = 2 AND field_name = 'village' AND document_id % 4 = 0 THEN least(1.0, (document_id % 150) / 100)
        WHEN document_id % 3 = 2 AND field_name = 'village' AND document_id % 4 = 2 THEN 1.0
        WHEN document_id % 3 = 2 AND field_name = 'village' AND document_id % 4 = 3 THEN 0.0
        WHEN document_id % 3 = 1 THEN NULL WHEN field_value IS NULL THEN 0.2 ELSE 0.6 END AS graded_confidence FROM reg_fields_long""",
)
def model_json_fields(spark, folder):
    # Parsing is all the work, and a small file is one task: the raw answers are dealt out first.
    answers = _answers(spark, folder).repartition("document_id")
    # Both forms are read off one row; the first form's columns make way for the second's.
    flat = J.with_answer(answers, "raw", "mapper").withColumnsRenamed({f: f"_f_{f}" for f in K.FIELDS})
    both = J.with_answer(flat, "raw", "second", with_confidence=True)
    entries = [
        F.struct(
            F.lit(f).alias("field_name"), F.col(f"_f_{f}.value").alias("field_value"),
            F.col(f"_f_{f}.confidence").alias("flat_confidence"), F.col(f"{f}.value").alias("graded_value"), F.col(f"{f}.confidence").alias("graded_confidence"),
        )
        for f in K.FIELDS
    ]
    return both.select("document_id", F.explode(F.array(*entries)).alias("e")).select("document_id", "e.*")


@query("json_repair")
def json_repair(spark, folder):
    wide = A.view(spark, folder, "reg_fields_wide")
    text = F.to_json(F.struct(*K.FIELDS))
    cut = wide.select("document_id", text.alias("t")).select(
        "document_id", F.expr("substring(t, 1, 1 + cast(pmod(xxhash64(document_id), length(t)) AS int))").alias("raw")
    )
    got = J.with_romanisations(cut, "raw")
    return got.select("document_id", F.col("answer").isNotNull().alias("parsed"), *K.ROMANISED_FIELDS)


_PAGE_FILES = """WITH p AS (SELECT page_id // 4 AS document_id, CASE WHEN page_id % 12 < 4 AND page_id % 2 = 0 THEN page_id || '.md' WHEN page_id % 5 = 4 THEN page_id || '.json' ELSE page_id || '.HTML' END AS name, url AS text FROM pages),
    k AS (SELECT *, suffix(lower(name), '.md') AS md FROM p WHERE regexp_matches(lower(name), '\\.(md|html|htm)$'))
    """


@query(
    "page_text",
    _PAGE_FILES + "SELECT document_id, string_agg(text, chr(10) ORDER BY name) AS text FROM k WHERE md = (SELECT bool_or(md) FROM k k2 WHERE k2.document_id = k.document_id) GROUP BY 1",
)
def page_text(spark, folder):
    return readings.document_text(_page_files(spark, folder))


@query(
    "page_rows",
    _PAGE_FILES + "SELECT document_id, name AS part, text FROM k WHERE md = (SELECT bool_or(md) FROM k k2 WHERE k2.document_id = k.document_id)",
)
def page_rows(spark, folder):
    return readings.page_rows(_page_files(spark, folder))


def _page_files(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    name = (
        F.when((F.col("page_id") % 12 < 4) & (F.col("page_id") % 2 == 0), F.concat(number, F.lit(".md")))
        .when(F.col("page_id") % 5 == 4, F.concat(number, F.lit(".json")))
        .otherwise(F.concat(number, F.lit(".HTML")))
    )
    return A.table(spark, folder, "pages").select(
        F.expr("page_id DIV 4").alias("document_id"), name.alias("name"), F.col("url").alias("text")
    )


@query(
    "response_payload",
    """SELECT doc_id, md5(text) AS text_hash, doc_id % 3 = 1 AS truncated, CASE WHEN doc_id % 4 < 3 THEN '3' END AS width FROM documents""",
)
def response_payload(spark, folder):
    documents = A.table(spark, folder, "documents")
    key = F.col("doc_id")
    reason = F.when(key % 3 == 0, "STOP").when(key % 3 == 1, "MAX_TOKENS").otherwise("FINISH_REASON_UNSPECIFIED")
    part = F.struct(F.col("text").alias("text"))
    response = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.array(part).alias("parts")).alias("content"), reason.alias("finishReason")
    )).alias("candidates")))
    vector = (
        F.when(key % 4 == 0, '{"embedding":{"values":[0.5,1,-2]}}').when(key % 4 == 1, '{"embedding":{"value":[1,2,3]}}')
        .when(key % 4 == 2, '{"embedding":[3.5,2.5,1]}').otherwise('{"embedding":{"values":[]}}')
    )
    return documents.select("doc_id", response.alias("r"), vector.alias("v")).select(
        "doc_id", F.md5(J.transcript(F.col("r"))).alias("text_hash"), J.is_truncated(F.col("r")).alias("truncated"),
        F.size(J.vector(F.col("v"))).cast("bigint").alias("width"),
    ).withColumn("width", F.when(F.col("width") >= 0, _text("width")))


# ---- quality -----------------------------------------------------------------------------------------------

# The second reader turned every 'e' into 'c' and the third lower-cased the text. A read that lacks a character
# altogether needs one edit for each of them in the truth, and that many suffice, so the distance is that count.
_CER_CTES = (
    A.with_views("reg_readings", "reg_manifest")
    + r""", s AS (SELECT m.script_type, r.engine, CASE WHEN coalesce(r.text, '') = '' OR m.rendered_text = '' THEN 1.0
      WHEN r.priority = 1 THEN 0.0
      WHEN r.priority = 2 THEN (length(m.rendered_text) - length(replace(m.rendered_text, 'e', ''))) / length(m.rendered_text)
      ELSE length(regexp_replace(m.rendered_text, '[^\p{Lu}]+', '', 'g')) / length(m.rendered_text) END AS cer
    FROM reg_readings r JOIN reg_manifest m ON m.doc_id = r.document_id WHERE coalesce(m.seeded_error_type, '') = '' AND NOT (r.error IS NOT NULL AND coalesce(r.text, '') = '')),
    b AS (SELECT script_type, engine, round(avg(cer), 4) AS cer, count(*) AS sample_size FROM s GROUP BY 1, 2) """
)


@query("cer_by_engine", _CER_CTES + "SELECT * FROM b")
def cer_by_engine(spark, folder):
    return quality.benchmark(A.view(spark, folder, "reg_readings"), A.view(spark, folder, "reg_manifest"))


@query("select_engine", _CER_CTES + "SELECT script_type, arg_min(engine, {'cer': cer, 'engine': engine}) AS engine FROM b GROUP BY 1")
def select_engine(spark, folder):
    return quality.select_engine(cer_by_engine(spark, folder))


@query("unusable_engines", A.with_views("reg_readings") + "SELECT engine, count(*) AS n FROM reg_readings WHERE error IS NOT NULL AND coalesce(text, '') = '' GROUP BY 1")
def unusable_engines(spark, folder):
    return quality.unusable_engines(A.view(spark, folder, "reg_readings"))


@query(
    "field_accuracy",
    A.with_views("reg_fields_wide")
    + f", x AS ({_EXTRACTED}) SELECT field_name, count(*) FILTER (lower(trim(coalesce(a, ''))) = lower(trim(coalesce(b, '')))) AS hits, count(*) AS total FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field_name, x.{f} AS a, w.{f} AS b FROM x JOIN reg_fields_wide w USING (document_id)" for f in K.FIELDS)
    + ") GROUP BY 1",
)
def field_accuracy(spark, folder):
    wide = A.view(spark, folder, "reg_fields_wide")
    manifest = wide.select(F.col("document_id").alias("doc_id"), F.struct(*K.FIELDS).alias("fields"))
    hits = quality.field_hits(quality.truth_fields(manifest), E.extract_fields(_rendered(wide)))
    return hits.groupBy("field_name").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total"))


_EXPECTED_RULE = "CASE document_id % 5 WHEN 0 THEN 'mandatory_fields_present' WHEN 1 THEN 'survey_number_format' WHEN 2 THEN 'date_plausibility' WHEN 3 THEN 'cross_document_consistency' END"


@query(
    "rule_catch_rate",
    _rules_sql()
    + f"SELECT e.rule_name, count(*) FILTER (r.result <> 'pass') AS caught, count(*) AS total FROM (SELECT document_id, {_EXPECTED_RULE} AS rule_name FROM reg_documents) e LEFT JOIN results r USING (document_id, rule_name) WHERE e.rule_name IS NOT NULL GROUP BY ROLLUP (e.rule_name)",
)
def rule_catch_rate(spark, folder):
    manifest = A.view(spark, folder, "reg_documents").selectExpr("document_id AS doc_id", f"{_EXPECTED_RULE} AS expected_failing_rule")
    return quality.rule_catches(manifest, _results(spark, folder))


_TRUE_FIELDS = " UNION ALL ".join(f"SELECT x.{f} AS a, w.{f} AS b FROM x JOIN reg_fields_wide w USING (document_id)" for f in K.FIELDS)


@query(
    "run_summary",
    _rules_sql()
    + f", x AS ({_EXTRACTED}), h AS (SELECT count(*) FILTER (lower(trim(coalesce(a, ''))) = lower(trim(coalesce(b, '')))) AS field_hits, count(*) AS field_total FROM ({_TRUE_FIELDS})), "
    + f"c AS (SELECT count(*) FILTER (r.result <> 'pass') AS rule_hits, count(*) AS rule_total FROM (SELECT document_id, {_EXPECTED_RULE} AS rule_name FROM reg_documents) e LEFT JOIN results r USING (document_id, rule_name) WHERE e.rule_name IS NOT NULL) "
    + "SELECT (SELECT count(*) FROM reg_documents) AS ingested, h.*, c.* FROM h, c",
)
def run_summary(spark, folder):
    wide = A.view(spark, folder, "reg_fields_wide")
    manifest = wide.select(
        F.col("document_id").alias("doc_id"), F.struct(*K.FIELDS).alias("fields"), F.expr(_EXPECTED_RULE).alias("expected_failing_rule")
    )
    return quality.run_summary(manifest, E.extract_fields(_rendered(wide)), _results(spark, folder), _run_folder(spark, "run-summary"))


# ---- similarity --------------------------------------------------------------------------------------------

_NEAR = """WITH v AS (SELECT vec_id AS document_id, embedding::DOUBLE[] AS e, label FROM embeddings),
  p AS (SELECT q.document_id AS query_id, q.label AS ql, c.document_id, c.label AS cl, list_cosine_similarity(q.e, c.e) AS s FROM v q JOIN v c ON q.document_id <> c.document_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, document_id) AS rank FROM p) """


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return A.table(spark, folder, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding", "label")


@query("similar_topk", _NEAR + "SELECT query_id, document_id, rank, round(s, 4) AS similarity FROM k WHERE rank <= 5")
def similar_topk(spark, folder):
    near = similarity.top_k(_embeddings(spark, folder).drop("label"))
    return near.select("query_id", "document_id", F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 4).alias("similarity"))


@query(
    "property_match",
    _NEAR
    + """SELECT query_id AS document_id, string_agg(document_id, ' ' ORDER BY rank) AS candidates, CASE WHEN min(rank) FILTER (ql = cl) IS NULL THEN 'new_property' ELSE 'existing_property' END AS match_status,
      cast(arg_min(document_id, rank) FILTER (ql = cl) AS string) AS matched_document_id FROM k WHERE rank <= 5 GROUP BY 1""",
)
def property_match(spark, folder):
    vectors = _embeddings(spark, folder)
    # The id is written in either case and with blanks; the match is blind to both.
    written = F.when(F.col("document_id") % 2 == 0, F.concat(F.lit(" p"), "label")).otherwise(F.concat(F.lit("P"), "label", F.lit(" ")))
    fields = vectors.select(
        "document_id", F.lit("property_id").alias("field_name"), written.alias("field_value"), F.lit(None).cast("string").alias("field_value_en")
    )
    found = similarity.similar_documents(vectors.drop("label"), fields)
    return found.select(
        "document_id", F.array_join(F.transform("candidates", lambda c: c["document_id"].cast("string")), " ").alias("candidates"),
        "match_status", _text("matched_document_id"),
    )


# ---- reviews -----------------------------------------------------------------------------------------------


def _field_rows(spark: SparkSession, folder: str) -> DataFrame:
    return A.view(spark, folder, "reg_fields_long").select(
        F.concat_ws("-", "document_id", "field_name").alias("id"), "document_id", "field_name", "field_value",
        F.lit(0.5).alias("confidence"), F.lit("mapper").alias("source"),
    )


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews with edits of known and unknown fields where the action is a correction."""
    rows = A.view(spark, folder, "reg_reviews").withColumnRenamed("review_id", "id")
    value = F.concat(F.lit("fixed "), F.col("id").cast("string"))
    edits = F.when(
        F.col("action") == "correct",
        F.create_map(
            F.lit("village"), value, F.when(F.col("id") % 2 == 0, "extent").otherwise("no_such_field"), value
        ),
    )
    return rows.withColumn("corrections", edits)


_EDITS = """, edits AS (SELECT document_id, review_id, reviewed_at, 'village' AS field_name, 'fixed ' || review_id AS v FROM reg_reviews WHERE action = 'correct'
  UNION ALL SELECT document_id, review_id, reviewed_at, 'extent', 'fixed ' || review_id FROM reg_reviews WHERE action = 'correct' AND review_id % 2 = 0) """


@query(
    "correction_audit",
    A.with_views("reg_reviews", "reg_fields_long") + _EDITS
    + "SELECT e.review_id, f.document_id || '-' || f.field_name AS extracted_field_id, coalesce(lag(e.v) OVER (PARTITION BY e.document_id, e.field_name ORDER BY e.reviewed_at, e.review_id), f.field_value) AS previous_value, e.v AS corrected_value FROM edits e JOIN reg_fields_long f USING (document_id, field_name)",
)
def correction_audit(spark, folder):
    audit = reviews.correction_audit(_reviews(spark, folder), _field_rows(spark, folder))
    return audit.select("review_id", "extracted_field_id", "previous_value", "corrected_value")


@query(
    "apply_reviews",
    A.with_views("reg_documents", "reg_reviews", "reg_fields_long") + _EDITS
    + """, last AS (SELECT document_id, arg_max(action, {'t': reviewed_at, 'i': review_id}) AS action FROM reg_reviews GROUP BY 1),
    lv AS (SELECT document_id, field_name, arg_max(v, {'t': reviewed_at, 'i': review_id}) AS v FROM edits GROUP BY 1, 2)
    SELECT f.document_id, f.field_name, coalesce(lv.v, f.field_value) AS field_value, CASE WHEN lv.v IS NULL THEN 0.5 ELSE 1.0 END AS confidence, CASE WHEN lv.v IS NULL THEN 'mapper' ELSE 'reconciled' END AS source,
      CASE WHEN last.action = 'flag' THEN 'flagged' WHEN last.action IS NOT NULL THEN 'reviewed' ELSE d.status END AS status
    FROM reg_fields_long f JOIN reg_documents d USING (document_id) LEFT JOIN last USING (document_id) LEFT JOIN lv ON lv.document_id = f.document_id AND lv.field_name = f.field_name""",
)
def apply_reviews(spark, folder):
    out = reviews.apply(A.view(spark, folder, "reg_documents"), _field_rows(spark, folder), _reviews(spark, folder))
    statuses = out["documents"].select("document_id", "status")
    return out["fields"].join(statuses, "document_id").select("document_id", "field_name", "field_value", "confidence", "source", "status")


_CORRECTED = (
    A.with_views("reg_documents", "reg_fields_wide", "reg_reviews", "reg_fields_long") + _EDITS
    + """, lv AS (SELECT document_id, field_name, arg_max(v, {'t': reviewed_at, 'i': review_id}) AS v FROM edits GROUP BY 1, 2), newrec AS (SELECT d.document_id, d.filename, """
    + ", ".join(f"coalesce((SELECT any_value(v) FROM lv WHERE lv.document_id = d.document_id AND field_name = '{f}'), w.{f}) AS {f}" for f in K.FIELDS)
    + " FROM reg_documents d LEFT JOIN reg_fields_wide w USING (document_id))"
)


@query(
    "apply_reviews_results",
    _rules_sql("SELECT * FROM newrec WHERE document_id IN (SELECT document_id FROM edits)", "SELECT * FROM newrec").replace(
        A.with_views("reg_documents", "reg_fields_wide"), _CORRECTED, 1
    ) + "SELECT * FROM results",
)
def apply_reviews_results(spark, folder):
    documents = A.view(spark, folder, "reg_documents")
    return reviews.apply(documents, _field_rows(spark, folder), _reviews(spark, folder), as_of=AS_OF)["revalidated"]


_GATE = (
    A.with_views("reg_documents", "reg_requests")
    + f""", r AS (SELECT q.*, d.reupload_count AS used, {_REASON} AS file_reason FROM reg_requests q LEFT JOIN reg_documents d USING (document_id)),
    """.replace("filename", "q.filename")
    + """a AS (SELECT *, coalesce(sum(CASE WHEN file_reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY requested_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fine_before FROM r)
    """
)


@query(
    "reupload_gate",
    _GATE
    + """SELECT request_id, document_id, CASE WHEN used IS NOT NULL AND file_reason IS NULL AND used + fine_before < 3 THEN cast(cast(used + fine_before + 1 AS int) AS string) END AS attempt,
      CASE WHEN used IS NULL THEN 'unknown_document' WHEN used + fine_before >= 3 THEN 'attempts_exhausted' ELSE file_reason END AS reject_reason FROM a""",
)
def reupload_gate(spark, folder):
    gated = reviews.gate_reuploads(A.view(spark, folder, "reg_requests"), A.view(spark, folder, "reg_documents"))
    return gated.select("request_id", "document_id", _text("attempt"), "reject_reason")


@query(
    "reupload_documents",
    _GATE
    + """, ok AS (SELECT * FROM a WHERE used IS NOT NULL AND file_reason IS NULL AND used + fine_before < 3),
    l AS (SELECT document_id, max(used + fine_before + 1) AS n, arg_max(filename, fine_before) AS filename FROM ok GROUP BY 1)
    SELECT d.document_id, coalesce(l.filename, d.filename) AS filename, CASE WHEN l.n IS NULL THEN d.status ELSE 'processing' END AS status, d.is_synthetic,
      CASE WHEN l.n IS NULL THEN d.overall_confidence END AS overall_confidence, cast(coalesce(l.n, d.reupload_count) AS int) AS reupload_count FROM reg_documents d LEFT JOIN l USING (document_id)""",
)
def reupload_documents(spark, folder):
    none = A.view(spark, folder, "reg_fields_long")
    out = reviews.reupload(A.view(spark, folder, "reg_documents"), none, none, A.view(spark, folder, "reg_requests"))
    return out["documents"].select("document_id", "filename", "status", "is_synthetic", "overall_confidence", "reupload_count")


# ---- table maintenance -------------------------------------------------------------------------------------


@query(
    "replace_children",
    A.with_views("reg_fields_long", "reg_reviews")
    + "SELECT document_id, field_name, field_value FROM reg_fields_long WHERE document_id NOT IN (SELECT document_id FROM reg_reviews WHERE action = 'flag') UNION ALL SELECT review_id, 'note', notes FROM reg_reviews WHERE action = 'flag'",
)
def replace_children(spark, folder):
    old = A.view(spark, folder, "reg_fields_long").drop("field_no")
    flags = A.view(spark, folder, "reg_reviews").filter("action = 'flag'")
    new = flags.select(F.col("review_id").alias("document_id"), F.lit("note").alias("field_name"), F.col("notes").alias("field_value"))
    return registry.replace_children(old, new, flags).select("document_id", "field_name", "field_value")


@query(
    "reconcile",
    """WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'),
    w AS (SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 5 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'MACHINERY')
    SELECT c_custkey, c_nationkey, coalesce(w.c_acctbal, c.c_acctbal) AS c_acctbal, CASE WHEN c.c_acctbal IS NULL THEN 'insert' WHEN w.c_acctbal IS NULL THEN 'delete' WHEN c.c_acctbal = w.c_acctbal THEN 'keep' ELSE 'update' END AS op
    FROM c FULL JOIN w USING (c_custkey, c_nationkey)""",
)
def reconcile(spark, folder):
    customers = A.table(spark, folder, "customer")
    current = customers.filter("c_mktsegment != 'BUILDING'")
    raised = F.when(F.col("c_nationkey") < 5, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    wanted = customers.filter("c_mktsegment != 'MACHINERY'").withColumn("c_acctbal", raised)
    return registry.reconcile(current, wanted, ["c_custkey", "c_nationkey"], ["c_acctbal"])


@query("insert_absent", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, 'DEFAULT' FROM customer WHERE c_acctbal < 0")
def insert_absent(spark, folder):
    customers = A.table(spark, folder, "customer")
    current = customers.filter("c_acctbal >= 0").select("c_custkey", "c_mktsegment")
    defaults = customers.select("c_custkey", F.lit("DEFAULT").alias("c_mktsegment"))
    return registry.insert_absent(current, defaults, "c_custkey")


@query(
    "upsert_embeddings",
    """SELECT vec_id AS document_id, CASE WHEN label >= 7 THEN 'old ' || label ELSE 'new ' || label END AS searchable_text, CASE WHEN label < 3 THEN NULL ELSE cast(len(embedding) AS string) END AS width FROM embeddings WHERE label <> 9""",
)
def upsert_embeddings(spark, folder):
    vectors = _embeddings(spark, folder)
    current = vectors.filter("label BETWEEN 2 AND 8").select("document_id", F.concat(F.lit("old "), "label").alias("searchable_text"), "embedding")
    # Labels from 7 on come with a blank text, which writes nothing; those under 3 with a null vector, which overwrites.
    text = F.when(F.col("label") >= 7, F.lit("  ")).otherwise(F.concat(F.lit("new "), "label"))
    new = vectors.select("document_id", text.alias("searchable_text"), F.when(F.col("label") >= 3, F.col("embedding")).alias("embedding"))
    merged = registry.upsert_embeddings(current, new)
    return merged.select("document_id", "searchable_text", F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("string")).alias("width"))


@query("add_missing_column", A.with_views("reg_documents") + "SELECT document_id, cast(CASE WHEN status = 'flagged' THEN reupload_count ELSE 0 END AS int) AS reupload_count FROM reg_documents")
def add_missing_column(spark, folder):
    documents = A.view(spark, folder, "reg_documents").select("document_id", "status", "reupload_count")
    older = documents.filter("status != 'flagged'").drop("reupload_count")
    merged = registry.merge_evolved(older, documents.filter("status = 'flagged'"), {"reupload_count": 0})
    return merged.select("document_id", "reupload_count")


# ---- samples, composite plans, streams ---------------------------------------------------------------------


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A clean record for every order and a defective copy for every customer."""
    orders, customers = A.table(spark, folder, "orders"), A.table(spark, folder, "customer")
    n = orders.agg(F.count(F.lit(1))).scalar()
    clean = samplegen.clean_records(orders.select(F.col("o_orderkey").alias("i")))
    return clean.unionByName(samplegen.seeded_records(customers.select(F.col("c_custkey").alias("k")), n))


@query("sample_set")
def sample_set(spark, folder):
    return _manifest(spark, folder).select(
        "doc_id", "filename", "script_type", "seeded_error_type", "expected_failing_rule", "fields.property_id", F.md5("rendered_text").alias("text_hash")
    )


@query("sample_scores")
def sample_scores(spark, folder):
    manifest = _manifest(spark, folder)
    documents = manifest.select(F.col("doc_id").alias("document_id"), "filename")
    # One copy of a record may repeat another copy's id; scoring is per distinct document.
    documents = documents.groupBy("document_id").agg(F.max("filename").alias("filename"))
    out = P.verify(documents, samplegen.perfect_reads(manifest), as_of=AS_OF)
    return quality.rule_catches(manifest, out["results"])


@query("process_documents")
def process_documents(spark, folder):
    documents = A.table(spark, folder, "documents").select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit("scan_"), "lang", F.lit("_"), "doc_id", F.lit(".png")).alias("filename")
    )
    done = P.process_documents(A.view(spark, folder, "reg_readings"), documents, label_chars=K.LABEL_VALUE_CHARS)
    return done.select(
        "document_id", "engine", "script_type", "overall_confidence", F.size("notes").alias("n_notes"),
        *[F.col(f"{f}.value").alias(f) for f in K.FIELDS],
    )


@query("stream_verify", _rules_sql() + "SELECT rule_name, result, count(*) AS n FROM results GROUP BY 1, 2")
def stream_verify(spark, folder):
    root = _run_folder(spark, "stream-verify")
    schema = A.table(spark, folder, "orders").schema
    orders = spark.readStream.schema(schema).parquet(f"{folder}/orders*.parquet")
    names = A.SQL["reg_documents"].replace("o_orderkey AS document_id", "o_orderkey AS document_id, o_orderkey, o_custkey, o_orderdate")
    both = A.SQL["reg_fields_wide"].replace("o_orderkey AS document_id", "document_id, filename").replace("{orders}", "{named}")
    records = spark.sql(both, named=spark.sql(names, orders=orders))
    running = SV.verify_records(records, f"{root}/registry", f"{root}/progress", as_of=AS_OF)
    running.awaitTermination()
    results = RegistryLog(f"{root}/registry").current(spark, "results")
    return reports.rule_outcome_counts(results)


@query(
    "stream_reupload_gate",
    _GATE
    + "SELECT document_id, count(*) AS accepted, cast(max(used + fine_before + 1) AS int) AS last_attempt FROM a WHERE used IS NOT NULL AND file_reason IS NULL AND used + fine_before < 3 GROUP BY 1",
)
def stream_reupload_gate(spark, folder):
    root = _run_folder(spark, "stream-gate")
    schema = A.table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")
    requests = spark.sql(A.SQL["reg_requests"], events=events)
    counts = A.view(spark, folder, "reg_documents").select("document_id", "reupload_count")
    gated = attempts.gate(requests.join(counts, "document_id"))
    running = (
        gated.writeStream.format("parquet").option("path", f"{root}/accepted").option("checkpointLocation", f"{root}/progress")
        .outputMode("append").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    accepted = spark.read.parquet(f"{root}/accepted").filter("attempt IS NOT NULL")
    return accepted.groupBy("document_id").agg(F.count(F.lit(1)).alias("accepted"), F.max("attempt").alias("last_attempt"))


def _in_drops(drops: list[DataFrame], root: str, start: Callable) -> RegistryLog:
    """Write files drop by drop and let the stream catch up after each: one batch a drop, restarted in between."""
    spark = drops[0].sparkSession
    for drop in drops:
        drop.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(drop.schema).parquet(f"{root}/in")
        start(stream, f"{root}/registry", f"{root}/progress").awaitTermination()
    return RegistryLog(f"{root}/registry")


# Every third document was uploaded twice; its primary read is one of the first upload.
_OLD_READ = "document_id % 3 = 0 AND priority = 1"
_WINNER = """r AS (SELECT * FROM reg_readings WHERE NOT (""" + _OLD_READ + """)),
  g AS (SELECT document_id, max(confidence) FILTER (priority = 1) AS pc, max(confidence) FILTER (priority = 2) AS sc,
    coalesce(bool_or(coalesce(text, '') <> '' AND error IS NULL) FILTER (priority = 1), false) AS po, coalesce(bool_or(coalesce(text, '') <> '' AND error IS NULL) FILTER (priority = 2), false) AS so,
    coalesce(bool_or(coalesce(text, '') <> '' AND error IS NULL) FILTER (priority = 3), false) AS lo FROM r GROUP BY 1),
  w AS (SELECT document_id, po OR so OR lo AS ok, CASE WHEN so AND (NOT po OR (pc < 0.6 AND sc > pc)) THEN 'secondary' WHEN po THEN 'primary' ELSE 'last_resort' END AS engine FROM g)"""


@query(
    "stream_late_reads",
    A.with_views("reg_readings")
    + ", " + _WINNER + """, v AS (SELECT vec_id AS document_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
  n AS (SELECT q.document_id AS query_id, q.label AS ql, c.document_id, c.label AS cl, list_cosine_similarity(q.e, c.e) AS s FROM v q JOIN v c ON q.document_id <> c.document_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, document_id) AS rank FROM n),
  m AS (SELECT query_id AS document_id, string_agg(document_id, ' ' ORDER BY rank) AS candidates, CASE WHEN min(rank) FILTER (ql = cl) IS NULL THEN 'new_property' ELSE 'existing_property' END AS match_status,
    cast(arg_min(document_id, rank) FILTER (ql = cl) AS string) AS matched_document_id FROM k WHERE rank <= 5 GROUP BY 1)
  SELECT w.document_id, w.engine, w.ok, coalesce(m.candidates, '') AS candidates, m.match_status, m.matched_document_id FROM w LEFT JOIN m USING (document_id)""",
)
def stream_late_reads(spark, folder):
    """Primary and last-resort reads first, secondary reads later, every other document wholly in the first drop."""
    reads = A.view(spark, folder, "reg_readings").select(
        "*", F.concat(F.lit("scan-"), "document_id", F.lit(".png")).alias("filename"), F.lit("image/png").alias("mime_type"),
        F.lit(10).cast("bigint").alias("file_size_bytes"), F.lit("clerk").alias("uploaded_by"),
        F.when(F.expr(_OLD_READ), F.lit("2024-01-01")).otherwise("2024-01-02").cast("timestamp").alias("uploaded_at"),
    )
    late = (F.col("priority") == 2) & (F.col("document_id") % 2 == 0)
    vectors = _embeddings(spark, folder)
    labels = vectors.select("document_id", F.concat(F.lit("P"), "label").alias("property_id"))
    ids = A.table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"))
    # What a reading model answered: the id where it is known, and a place.
    answers = ids.join(labels, "document_id", "left").select(
        "document_id", F.to_json(F.struct("property_id", F.lit("Bhiwandi").alias("village"))).alias("raw")
    )

    def start(stream, path, progress):
        embed = lambda texts: texts.join(vectors, "document_id").select("document_id", "embedding")
        return SV.verify(stream, path, progress, as_of=AS_OF, embed=embed, options={"answers": answers})

    log = _in_drops([reads.filter(~late), reads.filter(late)], _run_folder(spark, "stream-late"), start)
    best, found = log.current(spark, "readings"), log.current(spark, "matches")
    return best.join(found, "document_id", "left").select(
        "document_id", "engine", "ok", F.array_join(F.transform("candidates", lambda c: c["document_id"].cast("string")), " ").alias("candidates"),
        "match_status", _text("matched_document_id"),
    )


_STATUS_EVENTS = "SELECT user_id * 10 + event_id % 10 AS document_id, event_type AS status, ts AS uploaded_at, event_id FROM {events}"
_DROPS = 3


@query(
    "live_status_counts",
    f"WITH e AS ({_STATUS_EVENTS.replace('{events}', 'events')}), b AS (SELECT unnest(range({_DROPS})) AS batch), "
    + f"l AS (SELECT batch, document_id, arg_max(status, (event_id % {_DROPS}, uploaded_at, event_id)) AS status FROM b JOIN e ON event_id % {_DROPS} <= batch GROUP BY ALL) "
    + "SELECT cast(batch AS int) AS batch, status, count(*) AS n FROM l GROUP BY ALL",
)
def live_status_counts(spark, folder):
    """Documents per status after each of three batches of status changes, from logged differences."""
    changes = spark.sql(_STATUS_EVENTS, events=A.table(spark, folder, "events"))
    # Fields compared after the time are in order of the columns, so the id comes before the status.
    changes = changes.select("document_id", "uploaded_at", "event_id", "status")
    drops = [changes.filter(F.col("event_id") % _DROPS == n) for n in range(_DROPS)]
    log = _in_drops(drops, _run_folder(spark, "stream-status"), SV.follow_statuses)
    after = [SV.live_status(log, spark, n).select(F.lit(n).alias("batch"), "status", F.col("count").alias("n")) for n in range(_DROPS)]
    return after[0].unionByName(after[1]).unionByName(after[2])


# ---- display, exchange files, failures -----------------------------------------------------------------------


@query(
    "review_actions",
    """SELECT event_id AS review_id, CASE WHEN event_type = 'click' AND event_id % 4 <> 0 THEN 'correct' ELSE 'approve' END AS action,
      cast(cast(floor(floor(value * 1000) / 1000 + 0.5) AS int) AS string) AS seconds FROM events""",
)
def review_actions(spark, folder):
    """What a submitted review counts as and how long it took; every fourth correction is empty."""
    events = A.table(spark, folder, "events").withColumn("opened", F.col("ts").cast("timestamp"))
    edits = F.when(F.col("event_id") % 4 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("village"), "props"))
    submitted = F.timestamp_millis(F.unix_millis("opened") + F.floor(F.col("value") * 1000))
    return events.select(
        F.col("event_id").alias("review_id"), V.review_action(F.when(F.col("event_type") == "click", edits)).alias("action"),
        V.review_seconds(F.col("opened"), submitted).cast("string").alias("seconds"),
    )


@query(
    "rule_labels",
    _rules_sql() + "SELECT replace(rule_name, '_', ' ') AS rule, result, printf('%.1f%%', count(*) * 100.0 / (SELECT count(*) FROM rec)) AS share FROM results GROUP BY 1, 2",
)
def rule_labels(spark, folder):
    """Outcomes under the names shown, with the share of records that have them."""
    found = _results(spark, folder)
    total = A.table(spark, folder, "orders").agg(F.count(F.lit(1))).scalar()
    counts = found.groupBy("rule_name", "result").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(V.rule_label(F.col("rule_name")).alias("rule"), "result", V.error_percent(F.col("n") / total).alias("share"))


@query(
    "mandatory_fields_shown",
    A.with_views("reg_fields_long")
    + "SELECT document_id, field_name, field_name IN (" + ", ".join(f"'{f}'" for f in K.MANDATORY_FIELDS) + ") AS mandatory FROM reg_fields_long",
)
def mandatory_fields_shown(spark, folder):
    fields = A.view(spark, folder, "reg_fields_long")
    return fields.select("document_id", "field_name", V.is_mandatory(F.col("field_name")).alias("mandatory"))


@query(
    "diagnostic_lines",
    """WITH l AS (SELECT doc_id AS document_id, string_split(replace(text, '. ', chr(10) || chr(10)), chr(10)) AS parts FROM documents),
      e AS (SELECT document_id, unnest(parts) AS note, generate_subscripts(parts, 1) - 1 AS line FROM l)
    SELECT document_id, line, md5(note) AS note_hash FROM e WHERE note <> ''""",
)
def diagnostic_lines(spark, folder):
    notes = A.table(spark, folder, "documents").select(
        F.col("doc_id").alias("document_id"), F.replace("text", F.lit(". "), F.lit("\n\n")).alias("extraction_notes")
    )
    return V.diagnostics(notes).select("document_id", F.col("line").cast("bigint").alias("line"), F.md5("note").alias("note_hash"))


@query(
    "camel_case_columns",
    A.with_views("reg_documents")
    + 'SELECT document_id AS "documentId", script_type AS "scriptType", reupload_count AS "reuploadCount", is_synthetic AS "isSynthetic" FROM reg_documents',
)
def camel_case_columns(spark, folder):
    return V.camel_columns(A.view(spark, folder, "reg_documents").select("document_id", "script_type", "reupload_count", "is_synthetic"))


@query(
    "newest_documents",
    A.with_views("reg_documents") + "SELECT document_id, filename FROM reg_documents ORDER BY uploaded_at DESC, document_id LIMIT 100",
)
def newest_documents(spark, folder):
    """The hundred documents uploaded last."""
    return registry.newest_first(A.view(spark, folder, "reg_documents")).limit(100).select("document_id", "filename")


@query(
    "pdf_files",
    """SELECT page_id, coalesce(page_id % 5 = 0 OR page_id % 3 = 0, false) AS pdf FROM pages""",
)
def pdf_files(spark, folder):
    """Scans known as PDF by their type or by their first bytes, whatever the other says."""
    pages = A.table(spark, folder, "pages")
    kind = F.when(F.col("page_id") % 5 == 0, "application/pdf").when(F.col("page_id") % 5 == 1, "image/png")
    content = F.concat(F.when(F.col("page_id") % 3 == 0, "%PDF-1.7 ").otherwise(" %PDF"), F.coalesce("html", F.lit(""))).cast("binary")
    return pages.select("page_id", V.is_pdf(kind, content).alias("pdf"))


@query(
    "word_confidence",
    """WITH c AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN [-1, -1] ELSE [doc_id % 97, -1, doc_id % 131, length(text) % 101] END AS w FROM documents),
      k AS (SELECT *, list_filter(w, lambda x: x <> -1) AS kept FROM c)
    SELECT doc_id, round(CASE WHEN w IS NULL THEN CASE WHEN trim(coalesce(text, '')) <> '' THEN 0.5 ELSE 0 END WHEN len(kept) = 0 THEN 0
      ELSE greatest(0, least(1, list_sum(kept) / len(kept) / 100)) END, 9) AS confidence FROM k""",
)
def word_confidence(spark, folder):
    key = F.col("doc_id")
    words = F.array(key % 97, F.lit(-1).cast("bigint"), key % 131, (F.length("text") % 101).cast("bigint"))
    none = F.array(F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint"))
    given = F.when(key % 5 == 1, none).when(key % 5 != 0, words)
    return A.table(spark, folder, "documents").select("doc_id", F.round(X.word_confidence(given, F.col("text")), 9).alias("confidence"))


@query(
    "manifest_round_trip",
    A.with_views("reg_manifest", "reg_fields_wide")
    + f"""SELECT m.doc_id, m.filename, m.script_type, m.seeded_error_type, md5(m.rendered_text) AS text_hash, {", ".join(f"w.{f}" for f in K.FIELDS)}
      FROM reg_manifest m LEFT JOIN reg_fields_wide w ON w.document_id = m.doc_id""",
)
def manifest_round_trip(spark, folder):
    """A ground-truth manifest of all documents, written as an exchange file and read again."""
    fields = A.view(spark, folder, "reg_fields_wide").select(F.col("document_id").alias("doc_id"), F.struct(*K.FIELDS).alias("fields"))
    manifest = A.view(spark, folder, "reg_manifest").join(fields, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("doc_id"), "filename", "script_type", F.lit(True).alias("is_synthetic"), "seeded_error_type",
        F.lit(None).cast("string").alias("expected_failing_rule"), "fields", "rendered_text",
    )
    path = _run_folder(spark, "manifest")
    tables.write_manifest(manifest, path)
    back = tables.read_manifest_lines(spark, path)
    return back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "filename", "script_type", "seeded_error_type", F.md5("rendered_text").alias("text_hash"),
        *[F.col(f"fields.{f}").alias(f) for f in K.FIELDS],
    )


@query(
    "ready_documents",
    A.with_views("reg_documents", "reg_reviews")
    + "SELECT document_id, status FROM reg_documents WHERE status <> 'processing' AND document_id IN (SELECT document_id FROM reg_reviews)",
)
def ready_documents(spark, folder):
    """Of the documents someone asks for, those whose processing has ended."""
    return registry.ready(A.view(spark, folder, "reg_documents"), A.view(spark, folder, "reg_reviews")).select("document_id", "status")


@query(
    "processing_failures",
    A.with_views("reg_documents")
    + """, f AS (SELECT document_id, concat('reader stopped at ', document_id) AS error FROM reg_documents WHERE status = 'processing')
    SELECT document_id, CASE WHEN error IS NULL THEN status ELSE 'flagged' END AS status, CASE WHEN error IS NULL THEN overall_confidence END AS overall_confidence,
      'processing failed: ' || error AS extraction_notes FROM reg_documents LEFT JOIN f USING (document_id)""",
)
def processing_failures(spark, folder):
    """Documents whose processing broke are flagged with the error and lose their confidence."""
    documents = A.view(spark, folder, "reg_documents").select("document_id", "status", "overall_confidence", F.lit(None).cast("string").alias("extraction_notes"))
    broken = documents.filter("status = 'processing'")
    failures = broken.select("document_id", F.concat(F.lit("reader stopped at "), F.col("document_id").cast("string")).alias("error"))
    return P.fail(documents, failures)


@query(
    "best_candidates",
    "SELECT user_id AS query_id, event_id % 40 AS document_id, max(round(value, 6)) AS similarity FROM events GROUP BY 1, 2",
)
def best_candidates(spark, folder):
    """The best score of each candidate where several vectors of a document answered."""
    scored = A.table(spark, folder, "events").select(
        F.col("user_id").alias("query_id"), (F.col("event_id") % 40).alias("document_id"), F.round("value", 6).alias("similarity")
    )
    return similarity.best_per_candidate(scored)


@query(
    "index_rows",
    A.with_views("reg_fields_wide")
    + f""", t AS (SELECT document_id, concat_ws(chr(10), {', '.join(f"'{label}: ' || nullif(trim({f}), '')" for f, label in K.SEARCH_LABELS)}) AS searchable_text FROM reg_fields_wide)
    SELECT document_id, searchable_text, embedding IS NOT NULL AS has_vector FROM t LEFT JOIN embeddings ON vec_id = document_id WHERE searchable_text <> ''""",
)
def index_rows(spark, folder):
    """Rows for the embedding table: the text to search by, with its vector where there is one."""
    wide = _readings_from_wide(A.view(spark, folder, "reg_fields_wide"), lambda n: F.lit(0.9))
    rows = similarity.index_documents(wide, _embeddings(spark, folder))
    return rows.select("document_id", "searchable_text", F.col("embedding").isNotNull().alias("has_vector"))


@query(
    "hinted_script",
    A.with_views("reg_documents")
    + f""", h AS (SELECT document_id, {_name_hint_sql('filename')} AS by_name, document_id % 3 AS kind FROM reg_documents)
    SELECT document_id, CASE kind WHEN 0 THEN 'urdu_nastaliq' ELSE by_name END AS hint,
      CASE WHEN kind = 2 THEN 'english_latin' ELSE coalesce(CASE kind WHEN 0 THEN 'urdu_nastaliq' ELSE by_name END, '{K.DEFAULT_SCRIPT}') END AS script FROM h""",
)
def hinted_script(spark, folder):
    """Hints from a quick look (enough Urdu, too few letters, none) or the name, and the script settled on after reading."""
    documents = A.view(spark, folder, "reg_documents").select("document_id", "filename")
    kind = F.col("document_id") % 3
    quick = F.when(kind == 0, "محمد یوسف قریشی").when(kind == 1, "abc").otherwise("")
    text = F.when(kind == 2, "Property register of the village").otherwise("  ")
    hinted = documents.withColumn("hint", S.early_hint(quick, F.col("filename")))
    return hinted.select("document_id", "hint", S.final_script(text, F.col("hint")).alias("script"))


@query(
    "matra_folding",
    A.with_views("reg_fields_wide") + "SELECT document_id, replace(mutawalli_name || village, 'ि', 'ी') AS folded FROM reg_fields_wide",
)
def matra_folding(spark, folder):
    wide = A.view(spark, folder, "reg_fields_wide")
    return wide.select("document_id", X.fold_matra(F.concat("mutawalli_name", "village")).alias("folded"))


@query(
    "supplied_romanisation",
    A.with_views("reg_documents", "reg_fields_wide")
    + """, t AS (SELECT document_id, CASE WHEN document_id % 2 = 0 THEN ' Rendered name ' WHEN document_id % 4 = 1 THEN '  ' END AS name, CASE WHEN document_id % 5 <> 0 THEN 'Shahapur' END AS place FROM reg_documents WHERE document_id % 7 <> 0)
    SELECT d.document_id, CASE WHEN script_type <> 'english_latin' AND trim(t.name) <> '' THEN trim(t.name) END AS name_en,
      CASE WHEN script_type <> 'english_latin' THEN t.place END AS village_en FROM reg_documents d LEFT JOIN t USING (document_id)""",
)
def supplied_romanisation(spark, folder):
    """Renderings from outside fill the English side of native documents; blank ones fill nothing."""
    scripts = A.view(spark, folder, "reg_documents").select("document_id", "script_type")
    wide = _readings_from_wide(A.view(spark, folder, "reg_fields_wide"), lambda n: F.lit(0.9)).join(scripts, "document_id")
    key = F.col("document_id")
    given = {"mutawalli_name": F.when(key % 2 == 0, " Rendered name ").when(key % 4 == 1, "  "), "village": F.when(key % 5 != 0, "Shahapur")}
    translations = scripts.filter(key % 7 != 0).select(
        "document_id", *[given.get(f, F.lit(None).cast("string")).alias(f) for f in K.ROMANISED_FIELDS]
    )
    done = guards.romanise(wide, translations)
    return done.select("document_id", F.col("mutawalli_name.value_en").alias("name_en"), F.col("village.value_en").alias("village_en"))


@query(
    "demoted_names",
    A.with_views("reg_documents", "reg_fields_wide")
    + """, s AS (SELECT document_id, mutawalli_name AS v, script_type <> 'english_latin' AND coalesce(mutawalli_name, '') = 'Yusuf Pathan' AS suspect, script_type = 'urdu_nastaliq' AND document_id % 2 = 0 AS again FROM reg_documents JOIN reg_fields_wide USING (document_id)
      WHERE mutawalli_name IS NULL OR mutawalli_name = 'Yusuf Pathan')
    SELECT document_id, CASE WHEN suspect AND again THEN 'یوسف پٹھان' ELSE v END AS name, CASE WHEN suspect AND again THEN """
    + f"{K.RETRIED_CONFIDENCE} WHEN suspect THEN {K.SUSPECT_CONFIDENCE} ELSE 0.9 END AS confidence FROM s",
)
def demoted_names(spark, folder):
    """Latin names in native documents lose confidence, unless a second answer is in the right script."""
    scripts = A.view(spark, folder, "reg_documents").select("document_id", "script_type")
    wide = _readings_from_wide(A.view(spark, folder, "reg_fields_wide"), lambda n: F.lit(0.9)).join(scripts, "document_id")
    retries = scripts.filter("script_type = 'urdu_nastaliq' AND document_id % 2 = 0").select(
        "document_id", F.lit("mutawalli_name").alias("field_name"), F.lit("یوسف پٹھان").alias("value")
    )
    done = guards.demote_suspects(wide.filter("mutawalli_name.value IS NULL OR mutawalli_name.value = 'Yusuf Pathan'"), retries)
    return done.select("document_id", F.col("mutawalli_name.value").alias("name"), F.col("mutawalli_name.confidence").alias("confidence"))


@query(
    "replaced_table",
    A.with_views("reg_documents")
    + "SELECT document_id, CASE WHEN status = 'processing' THEN 'validated' ELSE status END AS status, cast(reupload_count + 2 AS bigint) AS n FROM reg_documents",
)
def replaced_table(spark, folder):
    """A table replaced twice by what is read from its own former version."""
    path = _run_folder(spark, "table")
    tables.replace_table(A.view(spark, folder, "reg_documents").select("document_id", "status", F.col("reupload_count").cast("bigint").alias("n")), path)
    for _ in range(2):
        now = tables.read_table(spark, path)
        settled = F.when(F.col("status") == "processing", "validated").otherwise(F.col("status"))
        tables.replace_table(now.withColumns({"status": settled, "n": F.col("n") + 1}), path)
    return tables.read_table(spark, path, "document_id", "status", "n")
