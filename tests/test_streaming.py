import datetime as dt

from pyspark.sql import functions as F

from veriloom import constants as K
from veriloom.operators import readings, reports, rules, samplegen
from veriloom.plans.verify import process_gathered
from veriloom.sources import scans, tables
from veriloom.sources.tables import RegistryLog
from veriloom.streaming import attempts, intake
from veriloom.streaming import verify as SV

AS_OF = "2024-06-30"


def records(spark, n=12):
    rows = [(f"d{i}", f"f{i}.png", f"P{i // 3}", "n", "412/2", "1999-01-01", None, None) for i in range(n)]
    return spark.createDataFrame(rows, "document_id string, filename string, " + ", ".join(f"{f} string" for f in K.FIELDS))


def run(spark, tmp_path, name, parts):
    source, target = tmp_path / f"{name}-in", str(tmp_path / f"{name}-out")
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(source / f"part={i}"))
    stream = (
        spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1 if len(parts) > 1 else 100).option("recursiveFileLookup", True)
        .parquet(str(source))
    )
    SV.verify_records(stream, target, str(tmp_path / f"{name}-cp"), as_of=AS_OF).awaitTermination()
    return RegistryLog(target)


def test_one_batch_equals_the_batch_result(spark, tmp_path):
    log = run(spark, tmp_path, "one", [records(spark)])
    want = rules.validate(records(spark), as_of=AS_OF)
    assert sorted(map(str, log.current(spark, "results").select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_many_batches_hold_the_same_documents(spark, tmp_path):
    df = records(spark)
    parts = [df.filter(f"pmod(hash(document_id), 3) = {i}") for i in range(3)]
    log = run(spark, tmp_path, "many", parts)
    assert log.current(spark, "documents").count() == 12 and log.current(spark, "results").count() == 48
    # A record's outcome sees what came before or with it; validated again, all see each other.
    again = rules.revalidate(df.select("document_id"), log.current(spark, "documents"), as_of=AS_OF)
    assert sorted(map(str, again.collect())) == sorted(map(str, rules.validate(df, as_of=AS_OF).collect()))


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    log = RegistryLog(str(tmp_path / "log"))
    first, second = records(spark).filter("document_id < 'd5'"), records(spark).filter("document_id >= 'd5'")
    for batch_id, batch in ((0, first), (1, second)):
        SV.write_batch(log, batch, batch_id, as_of=AS_OF)
    before = sorted(map(str, log.current(spark, "results").collect()))
    SV.write_batch(log, second, 1, as_of=AS_OF)
    assert sorted(map(str, log.current(spark, "results").collect())) == before
    # A later version of a document replaces it together with its children.
    SV.write_batch(log, first.limit(1), 2, as_of=AS_OF, config={r: False for r in K.RULE_ORDER[1:]})
    assert log.current(spark, "documents").count() == 12 and log.current(spark, "results").count() == 45
    log.compact(spark, "results", str(tmp_path / "compact"))
    assert tables.read_table(spark, str(tmp_path / "compact")).count() == 45


def test_uploads_and_reads_end_to_end(spark, tmp_path):
    manifest = samplegen.generate(spark, 6, 0)
    reads = samplegen.perfect_reads(manifest).join(manifest.select(F.col("doc_id").alias("document_id"), "filename"), "document_id")
    rows = reads.withColumns({
        "filename": F.when(F.col("document_id") == "urd-000", "x.exe").otherwise(F.col("filename")),
        "mime_type": F.lit(None).cast("string"), "file_size_bytes": F.lit(10), "uploaded_by": F.lit("u"),
        "uploaded_at": F.lit(dt.datetime(2024, 1, 1)),
    })
    source = str(tmp_path / "in")
    rows.write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    SV.verify(stream, str(tmp_path / "out"), str(tmp_path / "cp"), as_of=AS_OF).awaitTermination()
    log = RegistryLog(str(tmp_path / "out"))
    documents = log.current(spark, "documents")
    assert documents.count() == 5 and {r.status for r in documents.collect()} == {"validated"}
    assert log.current(spark, "fields").count() == 30 and log.current(spark, "results").count() == 20
    assert [r.reject_reason for r in log.history(spark, "rejects").collect()] == ["unsupported_type"]
    assert [(r.status, r["count"]) for r in SV.live_status(log, spark).collect()] == [("validated", 5)]


READ_SCHEMA = (
    "document_id string, filename string, mime_type string, file_size_bytes bigint, uploaded_by string, uploaded_at timestamp, "
    "engine string, priority int, text string, confidence double, error string"
)
LINES = "Property ID: WQ/MH/2001/000{n}\nMutawalli Name: Yusuf Pathan\nSurvey Number: 412/2"


def read(document_id, priority, confidence, day=1, filename="a.png", text=None, error=None):
    engine = {1: "primary", 2: "secondary", 3: "last_resort"}[priority]
    at = None if day is None else dt.datetime(2024, 1, day)
    return (document_id, filename, "image/png" if filename == "a.png" else None, 10, "u", at, engine, priority, text, confidence, error)


def feed(spark, root, drops, **options):
    """Run the stream once per drop, always from the same progress folder."""
    for rows in drops:
        spark.createDataFrame(rows, READ_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(READ_SCHEMA).parquet(f"{root}/in")
        SV.verify(stream, f"{root}/out", f"{root}/cp", as_of=AS_OF, **options).awaitTermination()
    return RegistryLog(f"{root}/out")


def engines(log, spark):
    return {r.document_id: (r.engine, r.ok) for r in log.current(spark, "readings").collect()}


def test_late_reads_are_merged_with_earlier_ones(spark, tmp_path):
    one, two = LINES.format(n=1), LINES.format(n=2)
    first = [
        read("a", 1, 0.4, text=one), read("b", 1, 0.9, text=one), read("c", 1, 0.0, error="broken"),
        read("d", 1, 0.9, text=one), read("e", 1, 0.5, day=None, text=one), read("z", 3, 0.2, text=two),
    ]
    late = [
        read("a", 2, 0.8, text=two),  # better than the weak primary read of the first batch
        read("b", 2, 0.95, text=two),  # the primary read is good enough to need no comparison
        read("c", 3, 0.1, text=two),  # nothing else could be read
        read("d", 2, 0.3, day=2, text=two),  # a second upload: the first one's reads are out
        read("e", 2, 0.6, day=None, text=two),
        read("a", 1, 0.4, text=one),  # a row that comes again
    ]
    log = feed(spark, str(tmp_path / "two"), [first, late])
    want = {"a": ("secondary", True), "b": ("primary", True), "c": ("last_resort", True), "d": ("secondary", True), "e": ("secondary", True), "z": ("last_resort", True)}
    assert engines(log, spark) == want
    # Only documents with new rows were verified again.
    assert {r.document_id for r in log.history(spark, "readings").filter("batch_id = 1").collect()} == set("abcde")
    assert log.current(spark, "fields").count() == 36
    together = feed(spark, str(tmp_path / "one"), [first + late])
    assert engines(together, spark) == want
    plain = lambda x: sorted(map(str, x.current(spark, "fields").collect()))
    assert plain(together) == plain(log)


def test_with_stored_answers_no_text_is_state(spark, tmp_path):
    one, hindi, urdu = LINES.format(n=1), "यह है और के लिए में " * 200, "محمد یوسف قریشی"
    first = [read("a", 1, 0.4, text=one), read("b", 1, 0.9, text=hindi), read("c", 1, 0.0, error="broken"), read("d", 1, 0.9, text="12 3")]
    late = [read("a", 2, 0.8, text=urdu), read("c", 2, 0.3, text=hindi + urdu), read("d", 2, 0.95, text=hindi), read("b", 3, 0.9, text=one)]
    answers = spark.createDataFrame([(d, '{"property_id": "P1", "village": "Bhiwandi"}') for d in "abcd"], "document_id string, raw string")
    log = feed(spark, str(tmp_path), [first, late], options={"answers": answers})
    rows = spark.createDataFrame(first + late, READ_SCHEMA)
    documents = rows.select("document_id", "filename").distinct()
    # The plain way: texts are kept until the script is known.
    whole = documents.join(readings.gather(rows), "document_id")
    want = process_gathered(whole, answers=answers).select("document_id", "engine", "script_type", "ok", "overall_confidence")
    assert sorted(map(str, log.current(spark, "readings").select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert {r.document_id: r.script_type for r in want.collect()} == {"a": K.URDU, "b": K.HINDI, "c": K.HINDI, "d": K.HINDI}
    state = spark.read.format("statestore").load(f"{tmp_path}/cp").select(F.to_json("value").alias("v")).collect()
    assert len(state) == 4 and all(one[:12] not in r.v and urdu not in r.v and len(r.v) < 2000 for r in state)


def test_refused_uploads_displace_nothing(spark, tmp_path):
    good, bad = read("a", 1, 0.9, text=LINES.format(n=1)), read("a", 1, 1.0, day=3, filename="a.exe", text="x")
    log = feed(spark, str(tmp_path), [[good], [bad], [read("a", 2, 0.2, text="y")]])
    assert engines(log, spark) == {"a": ("primary", True)}
    assert [(r.filename, r.reject_reason) for r in log.history(spark, "rejects").collect()] == [("a.exe", "unsupported_type")]
    assert [(r.status, r["count"]) for r in SV.live_status(log, spark).collect()] == [("validated", 1)]


def test_documents_are_matched_with_all_earlier_ones(spark, tmp_path):
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("e", [1.0, 0.05])], "document_id string, embedding array<float>"
    )
    embed = lambda texts: texts.join(vectors, "document_id").select("document_id", "embedding")
    one, two = LINES.format(n=1), LINES.format(n=2)
    drops = [
        [read("a", 1, 0.9, text=one), read("blank", 1, 0.9, text="nothing to find")],
        [read("b", 1, 0.9, text=one), read("c", 1, 0.9, text=two), read("d", 1, 0.9, text=one)],
        [read("a", 1, 0.9, day=2, text=two)],
        [read("e", 1, 0.9, text=one)],
    ]
    log = feed(spark, str(tmp_path), drops, embed=embed)
    found = {
        (r.document_id, r.batch_id): ([c.document_id for c in r.candidates], r.match_status, r.matched_document_id)
        for r in log.history(spark, "matches").collect()
    }
    assert found == {
        ("a", 0): ([], "new_property", None),
        ("b", 1): (["a", "c"], "existing_property", "a"),
        ("c", 1): (["b", "a"], "new_property", None),
        ("d", 1): ([], None, None),  # no vector
        ("a", 2): (["b", "c"], "existing_property", "c"),  # its new id is that of c; its old entry is no candidate
        ("e", 3): (["a", "b", "c"], "existing_property", "b"),  # a has another id by now
    }
    assert sorted(r.document_id for r in log.current(spark, "index").collect()) == ["a", "b", "c", "d", "e"]


def test_scans_are_taken_in_as_they_are_dropped(spark, tmp_path):
    folder = tmp_path / "scans"
    folder.mkdir()

    def drop(**files):
        for name, size in files.items():
            place = folder / name.replace("__", "/").replace("_DOT_", ".")
            place.parent.mkdir(exist_ok=True)
            place.write_bytes(b"%PDF" + b"x" * size)
        stream = scans.watch_scans(spark, str(folder))
        intake.take_in(stream, str(tmp_path / "out"), str(tmp_path / "cp"), uploaded_by="clerk").awaitTermination()

    drop(a_DOT_png=10, sub__b_sample_DOT_PDF=20, c_DOT_txt=5)
    drop(d_DOT_tiff=1, e_DOT_exe=1)
    drop()
    log = RegistryLog(str(tmp_path / "out"))
    taken = {(r.filename, r.status, r.batch_id) for r in log.history(spark, "documents").collect()}
    assert taken == {("a.png", "processing", 0), ("b_sample.PDF", "processing", 0), ("d.tiff", "processing", 1)}
    refused = {(r.filename, r.reject_reason, r.batch_id) for r in log.history(spark, "rejects").collect()}
    assert refused == {("c.txt", "unsupported_type", 0), ("e.exe", "unsupported_type", 1)}
    paths = {r.source_path.split("/")[-1]: r.document_id for r in log.current(spark, "sources").collect()}
    assert set(paths) == {"a.png", "b_sample.PDF", "d.tiff"} and len(set(paths.values())) == 3
    assert [(r.status, r["count"]) for r in SV.live_status(log, spark).collect()] == [("processing", 3)]
    # The source's schema is what the batch reader finds.
    assert spark.read.format("binaryFile").load(str(folder)).schema.simpleString() == spark.createDataFrame([], scans.SCAN_FILE).schema.simpleString()
    # Content is not read.
    assert "content" not in scans.watch_scans(spark, str(folder)).columns


def test_live_counts_equal_a_recount_after_each_batch(spark, tmp_path):
    log = RegistryLog(str(tmp_path))
    batches = [
        [("a", "processing"), ("b", "processing"), ("c", None)],
        [("a", "validated"), ("d", "processing"), ("c", None)],
        [("a", "approved"), ("b", "flagged"), ("c", "flagged")],
        [("b", "flagged")],
        [],
    ]
    assert SV.live_status(log, spark) is None
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "document_id string, status string")
        for _ in range(2):  # a replayed batch changes nothing
            SV.write_statuses(log, batch, n)
        counted = {r.status: r["count"] for r in SV.live_status(log, spark).collect()}
        assert counted == {r.status: r["count"] for r in reports.status_breakdown(log.current(spark, "documents")).collect()}
    # Counts as of an earlier batch stay available.
    assert {r.status: r["count"] for r in SV.live_status(log, spark, 0).collect()} == {"processing": 2, None: 1}


def test_attempts_are_counted_across_batches(spark, tmp_path):
    def rows(*ids):
        return spark.createDataFrame(
            [(1 if i < 50 else 2, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), 1 if i < 50 else 0, "bad.doc" if i == 3 else "a.png", None, 5) for i in ids],
            "document_id bigint, request_id bigint, requested_at timestamp, reupload_count int, filename string, mime_type string, file_size_bytes bigint",
        )

    source = tmp_path / "in"
    for n, part in enumerate([rows(1, 3, 60), rows(7, 5, 61, 62, 63)]):
        part.coalesce(1).write.parquet(str(source / f"p{n}"))
        # Files are taken by age.
    stream = spark.readStream.schema(rows(1).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    query = (
        attempts.gate(stream).writeStream.format("memory").queryName("gated").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.table("gated").collect()
    assert {(r.request_id, r.attempt) for r in got if r.request_id is not None} == {(1, 2), (5, 3), (60, 1), (61, 2), (62, 3)}
    assert sum(r.refused for r in got) == 2


def test_attempts_of_neighbouring_documents_are_counted_in_one_call(spark, tmp_path):
    asked = [(d, 10 * d + n, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=9 - n), abs(d) % 3, "a.png", None, 5) for d in range(-300, 600) for n in range(4)]
    rows = spark.createDataFrame(asked, "document_id bigint, request_id bigint, requested_at timestamp, reupload_count int, filename string, mime_type string, file_size_bytes bigint")
    rows.write.parquet(str(tmp_path / "in"))
    query = (
        attempts.gate(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("gated_blocks")
        .outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.table("gated_blocks").collect()
    want = {(d, 10 * d + 3 - n, abs(d) % 3 + n + 1) for d in range(-300, 600) for n in range(3 - abs(d) % 3)}
    assert {(r.document_id, r.request_id, r.attempt) for r in got if r.request_id is not None} == want
    assert {(r.document_id, r.refused) for r in got if r.request_id is None} == {(d, 1 + abs(d) % 3) for d in range(-300, 600)}
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 5  # a state row per block of documents, not per document
