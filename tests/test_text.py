from pyspark.sql import functions as F

from veriloom import constants as K
from veriloom.functions import display as V
from veriloom.functions import scripts as S
from veriloom.functions import text as X


def test_strip_and_lines_agree_with_python(column_values):
    samples = [" a ", " b ", "\t\n c\x1c", "d​e", "　", "", None, "x\u0085y", "a\x0bb"]
    assert column_values(X.strip, samples) == [s.strip() if s is not None else None for s in samples]
    joined = ["a\r\nb\rc\nd", "a\x0bb\x0cc\x1cd e f\x85g", "one"]
    assert column_values(X.split_lines, joined) == [s.splitlines() for s in joined]


def test_digits_differ_by_purpose(column_values):
    samples = ["४१२/२", "٤١٢", "۴۱۲", "412", None]
    assert column_values(X.western_or_null, samples) == ["412/2", "412", "412", None, None]
    assert column_values(X.extraction_digits, samples) == ["412/2", "٤١٢", "412", "412", None]


def test_markup_entities_first(column_values):
    samples = ["<p>a&amp;b</p>", "&lt;b&gt;bold&lt;/b&gt; x", " <td>1</td>\n\n <td>  2\t3 </td> ", "plain", "a &#2309; b", None]
    want = ["a&b", "bold x", "1\n2 3", "plain", "a अ b", None]
    assert column_values(X.strip_markup, samples) == want


def test_word_confidence(spark):
    rows = [([90, -1, 70], "t"), ([], "t"), ([-1], "t"), (None, " t "), (None, "  "), ([250], "t")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c array<int>, t string")
    got = [r.o for r in df.select("i", X.word_confidence(F.col("c"), F.col("t")).alias("o")).orderBy("i").collect()]
    assert got == [0.8, 0.0, 0.0, 0.5, 0.0, 1.0]


def test_identity_key(column_values):
    assert column_values(X.identity_key, [" WQ/1 ", "wq/1", "straße", "STRASSE"]) == ["wq/1", "wq/1", "strasse", "strasse"]


def test_detects_scripts(column_values):
    cases = {
        "वक्फ मालमत्ता आहे": K.MARATHI, "यह भूमि में और है": K.HINDI, "तत्र अस्ति": K.SANSKRIT, "सोऽहम्": K.SANSKRIT,
        "देवः रामः": K.SANSKRIT, "وقف جائیداد": K.URDU, "plain text": K.ENGLISH, "": None, "12345": None, "नाम": None,
    }
    assert column_values(S.detect, list(cases)) == list(cases.values())


def test_hint_is_only_overruled_by_clear_evidence(column_values):
    few, many = "यह है", "यह है और में किया हुआ के लिए"
    hinted = lambda c: S.detect(c, hint=K.MARATHI)
    assert column_values(hinted, [few, many, "नाम"]) == [K.MARATHI, K.HINDI, K.MARATHI]
    # Without any evidence even a hint of another family is returned.
    assert column_values(lambda c: S.detect(c, hint=K.URDU), ["नाम"]) == [K.URDU]
    assert column_values(lambda c: S.detect(c, min_evidence=5), ["abcd", "abcde"]) == [None, K.ENGLISH]


def test_filename_hints(column_values):
    names = ["WQ-UR-012.pdf", "x_marathi_y.pdf", "sa1.png", "hin.png", "eng_scan.png", "current.pdf", None]
    want = [K.URDU, K.MARATHI, K.SANSKRIT, K.HINDI, K.ENGLISH, None, None]
    assert column_values(S.from_filename, names) == want


def test_read_confidence(spark):
    def proxy(text, language, done=None, total=None):
        df = spark.createDataFrame([(text, done, total)], "t string, d int, n int")
        return df.select(S.read_confidence(F.col("t"), language, F.col("d"), F.col("n"))).first()[0]

    assert proxy("a" * 40, "en-IN") == 0.98
    assert proxy("a" * 40, "hi-IN") == 0.45
    assert proxy("ab", "en-IN", 1, 2) == round(0.55 + 0.15 + 0.15 * 0.5, 4)
    # Marks are letters neither above nor below the line: both letters of the pair are native.
    assert proxy("की" * 20, "mr-IN", 0, 4) == round(0.55 + 0.15, 4)
    assert proxy("x" * 40, "en-IN", 1, 0) == 0.98


def test_foreign_and_romanised_values(spark):
    rows = [("Yusuf", K.HINDI), ("Yusuf युसूफ", K.HINDI), ("محمد", K.HINDI), ("शेख", K.URDU), ("Yusuf", K.ENGLISH), ("12", K.URDU)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, s string")
    got = df.select("i", S.is_romanised(F.col("v"), F.col("s")).alias("r"), S.foreign_block(F.col("v"), F.col("s")).alias("f"))
    assert [(r.r, r.f) for r in got.orderBy("i").collect()] == [
        (True, None), (False, None), (False, "arabic"), (False, "devanagari"), (False, None), (False, None)
    ]


def test_display(column_values, spark):
    assert column_values(V.format_bytes, [1023, 1024, 1536, 26214400], "bigint") == ["1023 B", "1.0 KB", "1.5 KB", "25.0 MB"]
    assert column_values(V.whole_percent, [0.945, None, 1.0], "double") == ["95%", "—", "100%"]
    assert column_values(V.confidence_band, [0.9, 0.6, 0.59, None], "double") == ["high", "medium", "low", None]
    assert column_values(V.header_band, [None], "double") == ["low"]
    assert column_values(lambda c: V.storage_key(F.lit("doc-1"), c), ["a.PDF", "a.tar.GZ", ".png", "a.longextension", "a"]) == [
        "doc-1.pdf", "doc-1.gz", "doc-1", "doc-1", "doc-1"
    ]
    assert column_values(V.rule_label, ["date_plausibility"]) == ["date plausibility"]
    assert V.camel("overall_confidence") == "overallConfidence"
    reviewed = spark.createDataFrame(
        [({"village": "x"}, "2024-01-01 00:00:00", "2024-01-01 00:00:01.5"), ({}, "2024-01-01 00:00:00", "2024-01-01 00:00:02.4")],
        "c map<string,string>, a string, b string",
    ).select(V.review_action(F.col("c")), V.review_seconds(F.to_timestamp("a"), F.to_timestamp("b")))
    assert [tuple(r) for r in reviewed.collect()] == [("correct", 2), ("approve", 2)]


def test_upload_refusals(spark):
    rows = [("a.png", None, 5), ("a.doc", "image/png", 5), ("a.doc", None, 0), ("a.PDF", None, 26214401), ("a.tif", None, 0), ("", "image/png", 5), (None, None, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, m string, s bigint")
    got = [r.o for r in df.select("i", V.reject_reason(F.col("f"), F.col("m"), F.col("s")).alias("o")).orderBy("i").collect()]
    assert got == [None, None, "unsupported_type", "too_large", "empty", "unsupported_type", "unsupported_type"]


def test_markup_of_whole_pages_against_plain_python(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.select("html", X.strip_markup(F.col("html")).alias("text")).collect():
        bare = re.sub("<[^>]+>", " ", html.unescape(r.html))
        rows = [re.sub("[ \\t]+", " ", row).strip() for row in bare.splitlines()]
        assert r.text == "\n".join(row for row in rows if row)


def test_sizes_between_two_tenths_go_to_the_even_one(column_values):
    sizes = [1280, 1792, 1281, 1310720, 14942208, 14942209, 15466496]
    assert column_values(V.format_bytes, sizes, "bigint") == ["1.2 KB", "1.8 KB", "1.3 KB", "1.2 MB", "14.2 MB", "14.3 MB", "14.8 MB"]
