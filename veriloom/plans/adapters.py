"""Registry-shaped views over the driver's tables.

Each text is in the dialect Spark and DuckDB share; ``{name}`` stands for a table. The same text makes the Spark
input and the oracle's input, so the two cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ``document_id % n`` below only spreads kinds of rows over the whole table; no row is left out.
SQL = {
    "reg_documents": """
SELECT o_orderkey AS document_id,
       concat('rec-', cast(o_orderkey AS string),
              CASE o_orderkey % 4 WHEN 0 THEN '_marathi_sample' WHEN 1 THEN '_urdu_scan'
                                  WHEN 2 THEN '_hi_scan' ELSE '_scan' END,
              CASE WHEN o_orderkey % 3 = 0 THEN '.pdf' WHEN o_orderkey % 3 = 1 THEN '.tiff' ELSE '.docx' END) AS filename,
       CASE o_orderkey % 7 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'processing' WHEN 2 THEN 'extracted'
                           WHEN 3 THEN 'validated' WHEN 4 THEN 'reviewed' WHEN 5 THEN 'approved' ELSE 'flagged' END AS status,
       CASE o_orderkey % 5 WHEN 0 THEN 'urdu_nastaliq' WHEN 1 THEN 'marathi_devanagari' WHEN 2 THEN 'hindi_devanagari'
                           WHEN 3 THEN 'sanskrit_devanagari' ELSE 'english_latin' END AS script_type,
       o_orderkey % 4 = 0 AS is_synthetic,
       o_orderdate AS uploaded_at,
       concat('user', cast(o_custkey AS string), '@example.org') AS uploaded_by,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderkey * 37 % 101 AS double) / 100 END AS overall_confidence,
       cast(o_orderkey % 5 AS int) AS reupload_count
FROM {orders}""",
    "reg_fields_wide": """
SELECT o_orderkey AS document_id,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL
            WHEN o_orderkey % 10 = 0 THEN concat('WQ/MH/', cast(1995 + o_custkey % 20 AS string), '/', lpad(cast(o_custkey AS string), 5, '0'))
            ELSE concat('WQ/UP/2001/', lpad(cast(o_orderkey AS string), 6, '0')) END AS property_id,
       CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'शेख अब्दुल रहीम' WHEN 2 THEN 'محمد یوسف قریشی' ELSE 'Yusuf Pathan' END AS mutawalli_name,
       CASE o_orderkey % 6
            WHEN 0 THEN concat(cast(100 + o_orderkey % 900 AS string), '/', cast(1 + o_orderkey % 9 AS string), '-A')
            WHEN 1 THEN concat(cast(1 + o_orderkey % 99 AS string), '/1')
            WHEN 2 THEN cast(10000 + o_orderkey AS string)
            WHEN 3 THEN NULL
            WHEN 4 THEN translate(concat(cast(100 + o_orderkey % 900 AS string), '/2'), '0123456789', '०१२३४५६७८९')
            ELSE concat('  ', cast(100 + o_orderkey % 900 AS string), '/3 ') END AS survey_number,
       CASE o_orderkey % 8
            WHEN 0 THEN NULL
            WHEN 1 THEN concat(substring(cast(cast(o_orderdate AS date) AS string), 9, 2), '-', substring(cast(cast(o_orderdate AS date) AS string), 6, 2), '-', substring(cast(cast(o_orderdate AS date) AS string), 1, 4))
            WHEN 2 THEN concat(substring(cast(cast(o_orderdate AS date) AS string), 9, 2), '/', substring(cast(cast(o_orderdate AS date) AS string), 6, 2), '/', substring(cast(cast(o_orderdate AS date) AS string), 1, 4))
            WHEN 3 THEN '2031-01-01' WHEN 4 THEN '1975-06-30' WHEN 5 THEN '1899-12-31' WHEN 6 THEN '2001-02-30'
            ELSE cast(cast(o_orderdate AS date) AS string) END AS registration_date,
       concat(cast(o_orderkey % 9 AS string), '.25 ha') AS extent,
       CASE o_orderkey % 3 WHEN 0 THEN 'मौजे शहापूर' WHEN 1 THEN 'Bhiwandi' ELSE 'موضع شاہ پور' END AS village
FROM {orders}""",
    "reg_reviews": """
SELECT event_id AS review_id,
       user_id * 10 + event_id % 10 AS document_id,
       concat('reviewer', cast(user_id % 7 AS string)) AS reviewer_id,
       CASE event_type WHEN 'error' THEN 'flag' WHEN 'click' THEN 'correct' ELSE 'approve' END AS action,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS notes,
       ts AS reviewed_at,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE cast(floor(value) AS int) END AS duration_seconds
FROM {events}""",
    # Three reads of every document, over whole texts.
    "reg_readings": """
SELECT doc_id AS document_id, e.engine, e.priority,
       CASE WHEN doc_id % e.fail_mod = 0 THEN NULL
            WHEN e.priority = 1 THEN text
            WHEN e.priority = 2 THEN replace(text, 'e', 'c')
            ELSE lower(text) END AS text,
       CASE WHEN doc_id % e.fail_mod = 0 THEN cast(0 AS double)
            ELSE cast((doc_id * 31 + e.priority * 17) % 101 AS double) / 100 END AS confidence,
       CASE WHEN doc_id % e.fail_mod = 0 THEN 'engine unavailable' END AS error
FROM {documents} LATERAL VIEW_OF_ENGINES""",
    # A registry-shaped manifest of the same documents: the text as read is the truth.
    "reg_manifest": """
SELECT doc_id, concat('scan-', cast(doc_id AS string), '.png') AS filename,
       CASE lang WHEN 'en' THEN 'english_latin' WHEN 'de' THEN 'marathi_devanagari'
                 WHEN 'fr' THEN 'hindi_devanagari' ELSE 'sanskrit_devanagari' END AS script_type,
       CASE WHEN source IS NULL THEN 'bad_date' WHEN doc_id % 10 = 0 THEN '' END AS seeded_error_type,
       text AS rendered_text
FROM {documents}""",
    # Fields with the confidences of a first and a second reader.
    "reg_scored": """
SELECT document_id, field_name, field_value,
       cast((document_id * 7 + field_no * 13) % 101 AS double) / 100 AS confidence,
       CASE WHEN document_id % 4 = 3 THEN NULL ELSE cast((document_id * 11 + field_no * 29) % 101 AS double) / 100 END AS second_confidence,
       field_no
FROM {reg_fields_long}""",
    # Re-upload requests: one per event.
    "reg_requests": """
SELECT event_id AS request_id, user_id * 10 + event_id % 10 AS document_id,
       concat('again-', cast(event_id AS string), CASE WHEN event_id % 6 = 0 THEN '.docx' WHEN event_id % 6 = 1 THEN '_sample.PDF' ELSE '.png' END) AS filename,
       CASE WHEN event_id % 12 = 0 THEN 'image/png' ELSE 'application/octet-stream' END AS mime_type,
       CASE WHEN event_id % 13 = 0 THEN cast(0 AS bigint) ELSE cast(floor(value * 1000000) AS bigint) END AS file_size_bytes,
       ts AS requested_at
FROM {events}""",
    # Upload attempts: one per order.
    "reg_uploads": """
SELECT o_orderkey AS document_id,
       concat('Rec-', cast(o_orderkey AS string), CASE o_orderkey % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '_Demo.tiff' WHEN 2 THEN '.docx'
              WHEN 3 THEN '' WHEN 4 THEN '.template.jpeg' ELSE '.longextension' END) AS filename,
       CASE WHEN o_orderkey % 4 = 0 THEN 'image/webp' WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'text/plain' END AS mime_type,
       CASE WHEN o_orderkey % 17 = 0 THEN cast(0 AS bigint) ELSE cast(floor(o_totalprice * 100) AS bigint) END AS file_size_bytes,
       concat('user', cast(o_custkey AS string)) AS uploaded_by, o_orderdate AS uploaded_at
FROM {orders}""",
}

_ENGINES = "(SELECT 'primary' AS engine, 1 AS priority, 4 AS fail_mod UNION ALL SELECT 'secondary', 2, 6 UNION ALL SELECT 'last_resort', 3, 5)"
_FIELDS = ["property_id", "mutawalli_name", "survey_number", "registration_date", "extent", "village"]

# Spark unpivots in the row; DuckDB by union. Both give the same rows.
_SPARK_READINGS = SQL["reg_readings"].replace(
    "FROM {documents} LATERAL VIEW_OF_ENGINES",
    "FROM (SELECT doc_id, text, explode(array(named_struct('engine', 'primary', 'priority', 1, 'fail_mod', 4), "
    "named_struct('engine', 'secondary', 'priority', 2, 'fail_mod', 6), "
    "named_struct('engine', 'last_resort', 'priority', 3, 'fail_mod', 5))) AS e FROM {documents})",
)
_DUCK_READINGS = SQL["reg_readings"].replace(
    "FROM {documents} LATERAL VIEW_OF_ENGINES", f"FROM documents CROSS JOIN {_ENGINES} AS e"
)
_SPARK_LONG = (
    "SELECT document_id, stack(6, "
    + ", ".join(f"'{f}', {i + 1}, {f}" for i, f in enumerate(_FIELDS))
    + ") AS (field_name, field_no, field_value) FROM {reg_fields_wide}"
)
_DUCK_LONG = " UNION ALL ".join(
    f"SELECT document_id, '{f}' AS field_name, {i + 1} AS field_no, {f} AS field_value FROM reg_fields_wide"
    for i, f in enumerate(_FIELDS)
)

SPARK_SQL = SQL | {"reg_readings": _SPARK_READINGS, "reg_fields_long": _SPARK_LONG}
DUCK_SQL = SQL | {"reg_readings": _DUCK_READINGS, "reg_fields_long": _DUCK_LONG}
NEEDS = {"reg_fields_long": ["reg_fields_wide"], "reg_scored": ["reg_fields_wide", "reg_fields_long"]}
TABLES = ["documents", "embeddings", "events", "orders", "customer", "pages"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table or one of the registry-shaped views, as a lazy DataFrame."""
    if name in TABLES:
        return table(spark, folder, name)
    text = SPARK_SQL[name]
    inputs = {n: view(spark, folder, n) for n in [*TABLES, *SPARK_SQL] if f"{{{n}}}" in text}
    return spark.sql(text, **inputs)


def with_views(*names: str) -> str:
    """``WITH`` clause giving the oracle the same views."""
    ordered: list[str] = []
    for name in names:
        ordered += [n for n in [*NEEDS.get(name, []), name] if n not in ordered]
    parts = []
    for name in ordered:
        text = DUCK_SQL[name]
        for n in [*TABLES, *DUCK_SQL]:
            text = text.replace(f"{{{n}}}", n)
        parts.append(f"{name} AS ({text.strip()})")
    return "WITH " + ", ".join(parts) + " "
