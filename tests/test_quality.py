import random
import time

from pyspark.sql import functions as F

from veriloom import constants as K
from veriloom.operators import quality as Q
from veriloom.operators import samplegen
from veriloom.plans import verify as P
from veriloom.schemas import ENGINE_READS


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_distance_of_long_and_short_texts(spark):
    draw = random.Random(1)
    letters = "abआहे 𝒳"
    pairs = [("".join(draw.choices(letters, k=draw.randint(0, 160))), "".join(draw.choices(letters, k=draw.randint(0, 160)))) for _ in range(60)]
    base = "".join(draw.choices(letters, k=700))
    pairs += [(base, base), (base, base[1:] + "z"), (base, "q" * 300), ("a", base)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.d for r in df.orderBy("i").select("i", Q.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [table_distance(a, b) for a, b in pairs]


def test_rates(spark):
    rows = [("आहे", "आहत"), ("", "x"), ("x", ""), (None, "x"), ("abcdef", "a"), ("x", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, r string")
    got = [round(r.c, 4) for r in df.orderBy("i").select("i", Q.cer(F.col("h"), F.col("r")).alias("c")).collect()]
    assert got == [0.3333, 1.0, 1.0, 1.0, 1.0, 1.0]


def test_benchmark(spark):
    manifest = samplegen.generate(spark, 4, 2)
    one = manifest.filter("seeded_error_type IS NULL AND script_type = 'urdu_nastaliq'").select(F.col("doc_id").alias("document_id"), "rendered_text")
    made = [
        one.select("document_id", F.lit(e).alias("engine"), F.lit(1).alias("priority"), t.cast("string").alias("text"), F.lit(0.5).alias("confidence"), F.lit(err).cast("string").alias("error"))
        for e, t, err in (("same", F.col("rendered_text"), None), ("blank", F.lit(""), None), ("down", F.lit(None), "down"), ("odd", F.col("rendered_text"), "warned"))
    ]
    reads = spark.createDataFrame([], ENGINE_READS)
    for m in made:
        reads = reads.unionByName(m)
    got = {r.engine: (r.cer, r.sample_size) for r in Q.benchmark(reads, manifest).collect()}
    assert got == {"same": (0.0, 2), "blank": (1.0, 2), "odd": (0.0, 2)}
    assert [(r.engine, r.n) for r in Q.unusable_engines(reads).collect()] == [("down", 2)]
    assert [r.engine for r in Q.select_engine(Q.benchmark(reads, manifest)).collect()] == ["odd"]


def test_default_table_selects_the_primary(spark):
    rates = spark.createDataFrame(K.ERROR_RATE_DEFAULTS, "script_type string, engine string, cer double, sample_size int")
    assert {r.script_type: r.engine for r in Q.select_engine(rates).collect()} == {K.URDU: "primary", K.MARATHI: "primary"}


def test_sample_set_end_to_end(spark, tmp_path):
    manifest = samplegen.generate(spark, 80, 20)
    rows = manifest.collect()
    assert len(rows) == 100 and len({r.doc_id for r in rows}) == 100
    again = samplegen.generate(spark, 80, 20).repartition(3)
    assert sorted(map(str, rows)) == sorted(map(str, again.collect()))
    clean = [r for r in rows if r.seeded_error_type is None]
    assert len(clean) == 80 and all(len(r.rendered_text.split("\n")) == 7 for r in clean)
    assert {r.seeded_error_type for r in rows} == {None, *K.SEEDED_DEFECTS}
    for r in rows:
        if r.seeded_error_type == "missing_mandatory":
            assert len(r.rendered_text.split("\n")) == 6 and None in tuple(r.fields)
    documents = manifest.select(F.col("doc_id").alias("document_id"), "filename")
    out = P.verify(documents, samplegen.perfect_reads(manifest), as_of="2024-06-30")
    summary = Q.run_summary(manifest, out["fields"], out["results"], str(tmp_path / "run")).first()
    assert summary.ingested == 100 and summary.field_total == 600
    assert summary.field_hits / summary.field_total >= 0.9
    assert summary.rule_hits >= 18 and summary.rule_total == 20
    # The totals are those of the rows written.
    assert spark.read.parquet(str(tmp_path / "run/fields")).filter("hit").count() == summary.field_hits
    assert spark.read.parquet(str(tmp_path / "run/rules")).filter("fired").count() == summary.rule_hits
    nothing = Q.run_summary(manifest.limit(0), out["fields"], out["results"], str(tmp_path / "none")).first()
    assert tuple(nothing) == (0, 0, 0, 0, 0)
    assert out["fields"].count() == 600 and out["results"].count() == 400
    scores = Q.score(manifest, out["fields"], out["results"])
    assert scores["decisions"].count() == 100
    caught = {r.rule_name: (r.caught, r.total) for r in scores["catches"].collect()}
    assert sum(t for n, (_, t) in caught.items() if n) == caught[None][1]


def test_two_nulls_are_a_hit(spark):
    truth = spark.createDataFrame([("d", "village", None), ("d", "extent", "A "), ("d", "x", "v")], "document_id string, field_name string, expected string")
    found = spark.createDataFrame([("d", "village", None), ("d", "extent", " a")], "document_id string, field_name string, field_value string")
    assert {r.field_name: r.hit for r in Q.field_hits(truth, found).collect()} == {"village": True, "extent": True, "x": False}


def test_distance_takes_time_by_difference_only():
    draw = random.Random(8)
    for size, edits in ((5, 3), (40, 6), (300, 1), (300, 40), (300, 290), (700, 90)):
        for _ in range(12):
            a = draw.choices("abcआ𝒳", k=size)
            b = list(a)
            for _ in range(draw.randint(0, edits)):
                at = draw.randrange(len(b) + 1)
                b[at : at + draw.randint(0, 2)] = draw.choices("abcdआ", k=draw.randint(0, 2))
            a, b = "".join(a), "".join(b)
            want = table_distance(a, b)
            assert Q.distance(a, b) == Q.distance(b, a) == want
            if a and b:
                wide, narrow = sorted((Q._points(a), Q._points(b)), key=len, reverse=True)
                assert all(Q._in_band(wide, narrow, k) == want for k in range(max(want, 1), want + 9, 4))
    long = "".join(draw.choices("eabcdEFG ", k=120_000))
    began = time.process_time()
    assert Q.distance(long, long.replace("e", "c")) == long.count("e")
    assert Q.distance(long, long.lower()) == sum(map(str.isupper, long))
    assert Q.distance(long, long[1:50_000] + "zz" + long[50_000:] + "q") == 4
    assert time.process_time() - began < 2
