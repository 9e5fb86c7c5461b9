import datetime as dt

import pytest
from pyspark.sql import functions as F

from veriloom import constants as K
from veriloom import schemas
from veriloom.functions import display as V
from veriloom.operators import registry as G
from veriloom.operators import reports
from veriloom.operators import reviews as R
from veriloom.operators import samplegen
from veriloom.sources import scans, tables


def documents(spark, n=23):
    rows = [
        (f"d{i:02d}", f"File-{i}.png", K.STATUSES[i % 7], K.URDU, i % 2 == 0, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "u", None if i % 5 == 0 else i / 23, None, i % 4)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, (
        "document_id string, filename string, status string, script_type string, is_synthetic boolean, uploaded_at timestamp, uploaded_by string, "
        "overall_confidence double, extraction_notes string, reupload_count int"
    ))


def test_pages_are_clamped(spark):
    docs = documents(spark)
    ids = lambda page: [(r.serial, r.document_id) for r in page.orderBy("serial").collect()]
    assert ids(G.page(docs, 1)) == [(i + 1, f"d{22 - i:02d}") for i in range(10)]
    assert ids(G.page(docs, 3)) == [(21, "d02"), (22, "d01"), (23, "d00")]
    assert ids(G.page(docs, 99)) == ids(G.page(docs, 3)) and ids(G.page(docs, 0)) == ids(G.page(docs, 1))
    assert len(ids(G.page(docs.limit(20), 5))) == 10
    assert ids(G.page(docs.filter("false"), 4)) == []


def test_deep_pages_are_found_by_position(spark):
    rows = [(None if i % 7 == 0 else i % 5, i) for i in range(157)]
    df = spark.createDataFrame(rows, "t int, id bigint").repartition(5)
    for order in ([("t", False), ("id", True)], [("t", True), ("id", False)]):
        from_null = lambda t: (t is not None, t or 0)
        ranked = sorted(rows, key=lambda r: r[1], reverse=not order[1][1])
        ranked = sorted(ranked, key=lambda r: from_null(r[0]), reverse=not order[0][1])
        for slice_rows, number in ((1, 2), (10, 2), (10, 9), (10, 15), (10, 16), (10, 10_000_000), (250_000, 7)):
            got = G.page(df, number, 10, order, slice_rows).orderBy("serial").collect()
            start = (min(number, 16) - 1) * 10
            assert [(r.t, r.id) for r in got] == ranked[start:start + 10]
            assert [r.serial for r in got] == list(range(start + 1, start + 1 + len(got)))


def test_search_and_queue(spark):
    docs = documents(spark)
    assert G.search(docs).count() == 23
    assert {r.document_id for r in G.search(docs, " FILE-1 ", "approved").collect()} == {"d11", "d12", "d18", "d19"}
    assert G.search(docs, date_from="2024-01-01", date_to="2024-01-01").count() == 23
    assert G.search(docs, date_to="2023-12-31").count() == 0
    assert {r.status for r in G.queue(docs).collect()} == {"extracted", "validated"}
    keys = spark.createDataFrame([("d01",), ("d02",)], "document_id string")
    assert [r.document_id for r in G.ready(docs, keys).collect()] == ["d02"]


def test_detail_never_multiplies_children(spark):
    docs = documents(spark, 3).select("document_id")
    fields = spark.createDataFrame([("d00", "village", "x"), ("d00", "extent", "y"), ("d00", "owner", "z"), ("d00", "village", "w")], "document_id string, field_name string, field_value string")
    results = spark.createDataFrame(
        [("d00", "custom", "fail", "m"), ("d00", "date_plausibility", "pass", "m"), ("d00", "mandatory_fields_present", "fail", "m")],
        "document_id string, rule_name string, result string, message string",
    )
    got = {r.document_id: r for r in G.detail(docs, fields, results).collect()}
    assert [(f.field_name, f.field_value) for f in got["d00"].fields] == [("extent", "y"), ("village", "w"), ("village", "x"), ("owner", "z")]
    assert [v.rule_name for v in got["d00"].validations] == ["mandatory_fields_present", "date_plausibility", "custom"]
    assert got["d01"].fields == [] and got["d01"].validations == []


def test_reconcile_and_upserts(spark):
    have = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "x")], "k string, n int, s string")
    want = spark.createDataFrame([("a", 1, None), ("b", 2, "y"), ("d", 4, "x")], "k string, n int, s string")
    ops = G.reconcile(have, want, ["k"], ["n", "s"])
    assert {r.k: r.op for r in ops.collect()} == {"a": "keep", "b": "update", "c": "delete", "d": "insert"}
    assert sorted(map(tuple, G.apply_operations(ops).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.k: r.s for r in G.insert_absent(have, want, "k").collect()} == {"a": None, "b": "x", "c": "x", "d": "x"}
    once = G.replace_children(have.withColumnRenamed("k", "document_id"), want.withColumnRenamed("k", "document_id"), want.withColumnRenamed("k", "document_id"))
    twice = G.replace_children(once, want.withColumnRenamed("k", "document_id"), want.withColumnRenamed("k", "document_id"))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert G.drop_orphans(have, want, "k").count() == 2


def test_defaults_follow_the_same_reconcile(spark):
    rows = spark.createDataFrame(K.ERROR_RATE_DEFAULTS, "script_type string, engine string, cer double, sample_size int")
    old = rows.filter("engine != 'secondary'").withColumn("cer", F.col("cer") + 0.01).unionByName(
        spark.createDataFrame([(K.URDU, "retired", 0.1, 5)], rows.schema)
    )
    ops = G.reconcile(old, rows, ["script_type", "engine"], ["cer", "sample_size"])
    assert {r.op: r.n for r in ops.groupBy("op").agg(F.count("*").alias("n")).collect()} == {"update": 6, "insert": 2, "delete": 1}


def test_embeddings_null_overwrites_and_blank_does_not(spark):
    have = spark.createDataFrame([("a", "t", [1.0]), ("b", "t", [1.0])], "document_id string, searchable_text string, embedding array<double>")
    new = spark.createDataFrame([("a", "u", None), ("b", " \t", [2.0]), ("c", "v", [3.0])], have.schema)
    got = {r.document_id: (r.searchable_text, r.embedding) for r in G.upsert_embeddings(have, new).collect()}
    assert got == {"a": ("u", None), "b": ("t", [1.0]), "c": ("v", [3.0])}


def test_evolution_and_diagnostics(spark):
    df = documents(spark, 2)
    assert G.add_missing(df.drop("reupload_count"), {"reupload_count": ("int", 0)}).filter("reupload_count = 0").count() == 2
    noted = df.withColumn("extraction_notes", F.lit("one\n\ntwo"))
    assert [(r.line, r.note) for r in V.diagnostics(noted.limit(1)).collect()] == [(0, "one"), (2, "two")]
    assert "overallConfidence" in V.camel_columns(df).columns
    assert not G.check_enumeration(df.limit(1), "status", ["x"]).first().status_ok


def test_derived_ids_are_stable(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string")
    ids = [r.i for r in df.select(G.derived_id("val", "x", "y").alias("i")).collect()]
    assert len(set(ids)) == 2 and all(i.startswith("val-") and len(i) == 16 for i in ids)


def test_scans_from_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.png").write_bytes(b"%PDF but named png")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {r.filename: (r.mime_type, r.reject_reason) for r in scans.read_scans(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("application/pdf", None), "b.png": ("image/png", None), "c.txt": (None, "unsupported_type")}
    assert {r.filename: r.is_pdf for r in scans.mark_pdfs(spark, str(tmp_path)).collect()} == {"a.pdf": True, "b.png": True, "c.txt": False}


def test_manifest_and_table_files(spark, tmp_path):
    manifest = samplegen.generate(spark, 6, 4)
    tables.write_manifest(manifest, str(tmp_path / "m"))
    again = tables.read_manifest_lines(spark, str(tmp_path / "m"))
    assert again.schema == schemas.MANIFEST
    assert sorted(map(str, again.collect())) == sorted(map(str, manifest.collect()))
    array = "[" + ",".join(r.value for r in again.select(F.to_json(F.struct("*")).alias("value")).collect()) + "]"
    (tmp_path / "ground_truth.json").write_text(array, encoding="utf-8")
    assert tables.read_manifest(spark, str(tmp_path / "ground_truth.json")).count() == 10
    target = str(tmp_path / "t")
    tables.replace_table(spark.range(3), target)
    tables.replace_table(spark.range(5), target)
    assert tables.read_table(spark, target, "id").count() == 5
    with pytest.raises(ValueError):
        tables.replace_table(spark.range(0), target)
    assert tables.read_table(spark, target).count() == 5


def test_a_replacement_that_stops_anywhere_leaves_a_whole_table(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    tables.replace_table(spark.range(3), target)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:  # data written, not yet marked
        broken.setattr(tables, "_publish", stop)
        with pytest.raises(KeyboardInterrupt):
            tables.replace_table(spark.range(4), target)
    assert tables.read_table(spark, target).count() == 3
    with monkeypatch.context() as broken:  # marked, old versions not yet deleted
        broken.setattr(tables, "_retire", stop)
        for n in (5, 6, 7):
            with pytest.raises(KeyboardInterrupt):
                tables.replace_table(spark.range(n), target)
            assert tables.read_table(spark, target).count() == n
    # Mark deleted, data not: the folder is an orphan that no reader sees.
    oldest = sorted((tmp_path / "t" / "_versions").glob("0*"))[0]
    oldest.unlink()
    assert tables.read_table(spark, target).count() == 7
    before = tables.read_table(spark, target)
    tables.replace_table(before.selectExpr("id + 1 AS id"), target)
    assert before.count() == 7  # the former version is still there for who reads it
    assert sorted(r.id for r in tables.read_table(spark, target).collect()) == list(range(1, 8))
    assert len(list((tmp_path / "t" / "_versions").glob("0*"))) == 2
    # A plain folder is read as it is.
    spark.range(9).write.parquet(str(tmp_path / "plain"))
    assert tables.read_table(spark, str(tmp_path / "plain")).count() == 9


def review(i, doc, action, corrections=None, at=0, notes=None):
    return (i, doc, "r", action, notes, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=at), 30, corrections)


def test_batch_of_reviews(spark):
    docs = spark.createDataFrame([("a", "validated"), ("b", "validated"), ("c", "validated")], "document_id string, status string")
    fields = spark.createDataFrame(
        [("f1", "a", "village", "v0", None, 0.3, "m"), ("f2", "a", "extent", None, None, 0.3, "m"), ("f3", "b", "village", "w0", None, 0.3, "m")], schemas.EXTRACTED_FIELDS
    )
    given = spark.createDataFrame([
        review("r1", "a", "correct", {"village": "v1", "nonsense": "x"}, 1), review("r2", "a", "correct", {"village": "v2", "extent": "e2"}, 2),
        review("r3", "a", "flag", None, 3, "why"), review("r4", "b", "flag", None, 1), review("r5", "b", "approve", None, 2), review("r6", "zz", "approve"),
    ], schemas.REVIEWS)
    out = R.apply(docs, fields, given)
    assert {r.document_id: r.status for r in out["documents"].collect()} == {"a": "flagged", "b": "reviewed", "c": "validated"}
    assert {r.id: (r.field_value, r.confidence, r.source) for r in out["fields"].collect()} == {
        "f1": ("v2", 1.0, "reconciled"), "f2": ("e2", 1.0, "reconciled"), "f3": ("w0", 0.3, "m")
    }
    audit = {(r.review_id, r.extracted_field_id): (r.previous_value, r.corrected_value) for r in out["corrections"].collect()}
    assert audit == {("r1", "f1"): ("v0", "v1"), ("r2", "f1"): ("v1", "v2"), ("r2", "f2"): (None, "e2")}
    assert [r.id for r in out["rejects"].collect()] == ["r6"] and [r.document_id for r in out["touched"].collect()] == ["a"]
    assert [(r.reason, r.reviewer_id) for r in R.latest_flag(given).filter("document_id = 'a'").collect()] == [("why", "r")]


def test_reuploads(spark):
    docs = documents(spark, 4).withColumn("reupload_count", F.lit(1))
    rows = [(i, "d00", f"n{i}_test.png" if i != 2 else "bad.doc", None, 5, dt.datetime(2024, 1, i)) for i in (1, 2, 3, 4)] + [(9, "zz", "x.png", None, 5, dt.datetime(2024, 1, 1))]
    requests = spark.createDataFrame(rows, "request_id int, document_id string, filename string, mime_type string, file_size_bytes bigint, requested_at timestamp")
    gated = {r.request_id: (r.attempt, r.reject_reason) for r in R.gate_reuploads(requests, docs).collect()}
    assert gated == {1: (2, None), 2: (None, "unsupported_type"), 3: (3, None), 4: (None, "attempts_exhausted"), 9: (None, "unknown_document")}
    fields = spark.createDataFrame([("d00",), ("d01",)], "document_id string")
    out = R.reupload(docs, fields, fields, requests)
    row = out["documents"].filter("document_id = 'd00'").first()
    assert (row.filename, row.status, row.reupload_count, row.overall_confidence, row.is_synthetic) == ("n3_test.png", "processing", 3, None, True)
    assert [r.document_id for r in out["fields"].collect()] == ["d01"]


def test_cold_start_reports(spark):
    docs = documents(spark).withColumn("is_synthetic", F.lit(False))
    none = spark.createDataFrame([], "document_id string, action string, duration_seconds int, reviewed_at timestamp")
    assert tuple(reports.throughput(none, docs).first()) == (14, 6, 0.9, 95)
    zero = spark.createDataFrame([("d", "approve", 0, None), ("d", "flag", 500, None)], none.schema)
    assert tuple(reports.throughput(zero, docs).first())[3] == 95
    even = spark.createDataFrame([("d", "approve", 94, None), ("d", "correct", 95, None)], none.schema)
    assert tuple(reports.throughput(even, docs).first())[::3] == (38, 94)
    slow = spark.createDataFrame([("d", "approve", 9000, None)], none.schema)
    assert tuple(reports.throughput(slow, docs).first())[::3] == (14, 9000)
    assert {r.band: r["count"] for r in reports.confidence_bands(docs.filter("false")).collect()} == {"high": 0, "medium": 0, "low": 0}
    assert reports.dashboard(docs, none, "2024-01-01").first().approved_today == 0


def test_whole_queue_is_numbered_in_slices(spark):
    docs = documents(spark, 70).withColumn("status", F.lit("extracted"))
    got = R.queue_neighbours(docs, slice_rows=3).orderBy("position").collect()
    ids = [f"d{i:02d}" for i in range(70)]
    assert [(r.position, r.document_id) for r in got] == [(i + 1, d) for i, d in enumerate(ids)]
    assert [r.previous_id for r in got] == [None, *ids[:-1]] and [r.next_id for r in got] == [*ids[1:], None]
    after = {r.document_id: r.advance_to for r in R.next_after_action(docs, "uploaded_by", slice_rows=3).collect()}
    assert after["d00"] == "d01" and after["d69"] == "d00"
    assert R.next_after_action(docs.limit(1), "uploaded_by").first().advance_to is None
    whole = {r.document_id: r.advance_to for r in R.next_after_action(docs, slice_rows=3).collect()}
    assert whole == dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    assert R.next_after_action(docs.limit(1)).first().advance_to is None


def test_shipped_defaults(spark):
    configs = tables.default_rule_configs(spark)
    changed = configs.filter("key = 'date_plausibility'").withColumn("enabled", F.lit(False))
    merged = {r.key: r.enabled for r in G.insert_absent(changed, configs, "key").collect()}
    assert merged == {r: r != "date_plausibility" for r in K.RULE_ORDER}
    assert tables.default_error_rates(spark).count() == 8


def test_edits_meet_fields_by_document(spark):
    fields = spark.createDataFrame(
        [(1, "village", "a", 0.5, "mapper"), (1, "extent", "b", 0.5, "mapper"), (2, "village", None, 0.5, "mapper")],
        "document_id long, field_name string, field_value string, confidence double, source string",
    )
    edits = spark.createDataFrame(
        [(1, 1, "2024-01-01", {"village": "old", "extent": None}), (2, 1, "2024-01-02", {"village": "new", "survey_number": "no row"}), (3, 3, "2024-01-01", {"village": "x"})],
        "id long, document_id long, reviewed_at string, corrections map<string,string>",
    )
    got = {(r.document_id, r.field_name): (r.field_value, r.source) for r in R.corrected_fields(fields, edits).collect()}
    assert got == {(1, "village"): ("new", "reconciled"), (1, "extent"): (None, "reconciled"), (2, "village"): (None, "mapper")}
    wide = {r.document_id: (r.village, r.extent, r.survey_number) for r in R.corrected_values(fields, edits).collect()}
    assert wide == {1: ("new", None, None), 2: (None, None, None)}
    # Only edits are dealt by field; fields move by document, once.
    plan = R.corrected_fields(fields, edits)._jdf.queryExecution().executedPlan().toString()
    assert sum("hashpartitioning(document_id#" in line and "field_name#" in line for line in plan.splitlines()) <= 1
