"""Measurement: error rates per script and engine, field accuracy, seeded-defect catch rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom import constants as K
from veriloom.functions import text as X

SMALL_TABLE = 10_000
SMALL_BAND = 64
BAND_COLUMNS = 4096


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _surplus(a: np.ndarray, b: np.ndarray) -> int:
    """Characters, repeats counted, that one text has and the other lacks, the larger side: never above the distance."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    more = np.bincount(at[: len(a)], minlength=len(values)) - np.bincount(at[len(a) :], minlength=len(values))
    return int(max(more[more > 0].sum(), -more[more < 0].sum()))


def _in_band(long: np.ndarray, short: np.ndarray, band: int) -> int:
    """Edit distance where it is at most ``band``, else a number above that.

    Myers' bit vectors over the ``2 * band + 1`` cells of a column around the diagonal, which move down a row a column;
    no path of at most ``band`` edits leaves them. A column is a few numbers of as many bits.
    """
    full = (1 << (2 * band + 1)) - 1
    last = band + len(long) - len(short)
    up, down, distance = full ^ ((1 << band) - 1), 0, len(long) - len(short)
    step = 2 * band + BAND_COLUMNS
    for at in range(0, len(short), step):
        # The rows that these columns can reach, one bit vector for each character in them.
        first = at - band
        rows = long[max(first, 0) : at + step + band]
        columns = short[at : at + step]
        places = {
            int(c): int.from_bytes(np.packbits(rows == c, bitorder="little").tobytes(), "little") << max(-first, 0) for c in np.unique(columns)
        }
        for n, c in enumerate(columns.tolist()):
            same = (places[c] >> n) & full
            diagonal = (((same & up) + up) ^ up) & full | same | down
            right_up = down | ((diagonal | up) ^ full)
            right_down = diagonal & up
            distance += 1 - (diagonal >> last & 1)
            moved = diagonal >> 1
            up = right_down | ((moved | right_up) ^ full)
            down = moved & right_up
    return distance


def distance(a: str, b: str) -> int:
    """Exact edit distance, in a time that grows with length times distance.

    What both texts begin and end with is left out. Where as many characters differ in place as one text has too many, that
    is the distance. Otherwise bands are tried, each twice as wide, until the distance found fits into its band.
    """
    long, short = (_points(t) for t in ((a, b) if len(a) >= len(b) else (b, a)))
    for turn in (1, -1):
        x, y = long[::turn][: len(short)], short[::turn]
        differs = x != y
        common = int(differs.argmax()) if differs.any() else len(short)
        long, short = long[::turn][common:][::turn], short[::turn][common:][::turn]
    if not len(short):
        return len(long)
    most = len(long)
    if len(long) == len(short):
        differs = long != short
        most, least = int(differs.sum()), _surplus(long[differs], short[differs])
    else:
        least = _surplus(long, short)
    if least == most:
        return most
    band = min(max(least, SMALL_BAND), most)
    while (found := _in_band(long, short, max(band, len(long) - len(short)))) > band < most:
        band = min(2 * band, most)
    return found


def _distance_udf():
    def distances(left: pd.Series, right: pd.Series) -> pd.Series:
        found = [None if a is None or b is None else distance(a, b) for a, b in zip(left, right)]
        return pd.Series(found, dtype="Int64")

    return F.pandas_udf(distances, T.LongType())


def edit_distance(a: Column, b: Column) -> Column:
    """Exact edit distance of two texts of any length.

    Equal texts and small ones stay in the JVM. Long pairs go to Python in Arrow batches, where ``distance`` takes as
    much time as they differ; everything else sends nulls there.
    """
    small = F.length(a).cast("bigint") * F.length(b) <= SMALL_TABLE
    in_python = (a != b) & ~small
    far = _distance_udf()(F.when(in_python, a), F.when(in_python, b))
    return F.coalesce(far, F.when(a == b, 0).when(small, F.levenshtein(a, b)))


def cer(hypothesis: Column, reference: Column) -> Column:
    """Character error rate: edit distance over reference length, at most 1; 1 if either side is empty."""
    rate = edit_distance(hypothesis, reference) / F.length(reference)
    return F.when(X.is_blank(hypothesis) | X.is_blank(reference), 1.0).otherwise(F.least(rate, F.lit(1.0)))


def clean_documents(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.coalesce("seeded_error_type", F.lit("")) == "")


def usable_reads(reads: DataFrame) -> DataFrame:
    """Reads that count in a benchmark: all but those with an error and no text."""
    return reads.filter(F.col("error").isNull() | (F.col("error") == "") | ~X.is_blank(F.col("text")))


def scored_reads(reads: DataFrame, manifest: DataFrame) -> DataFrame:
    """Error rate of each usable read of each clean document."""
    truth = clean_documents(manifest).select(F.col("doc_id").alias("document_id"), "script_type", "rendered_text")
    # Merged, not broadcast: the texts have no size bound, and comparing them should be spread over all tasks.
    joined = usable_reads(reads).join(truth.hint("merge"), "document_id")
    return joined.select("document_id", "script_type", "engine", cer(F.col("text"), F.col("rendered_text")).alias("cer"))


def benchmark(reads: DataFrame, manifest: DataFrame) -> DataFrame:
    """Mean error rate to four places and sample size per script and engine."""
    return scored_reads(reads, manifest).groupBy("script_type", "engine").agg(
        F.bround(F.avg("cer"), 4).alias("cer"), F.count(F.lit(1)).alias("sample_size")
    )


def by_error_rate(rates: DataFrame) -> DataFrame:
    """Rates in the order they are shown: by script, lowest error rate first, equal rates by engine."""
    return rates.orderBy("script_type", "cer", "engine")


def unusable_engines(reads: DataFrame) -> DataFrame:
    failed = F.col("error").isNotNull() & (F.col("error") != "") & X.is_blank(F.col("text"))
    return reads.filter(failed).groupBy("engine").agg(F.count(F.lit(1)).alias("n"))


def select_engine(rates: DataFrame) -> DataFrame:
    """Engine with the lowest error rate per script; equal rates go to the first name."""
    return rates.groupBy("script_type").agg(F.min_by("engine", F.struct("cer", "engine")).alias("engine"))


def truth_fields(manifest: DataFrame) -> DataFrame:
    """Ground truth as long rows ``(document_id, field_name, expected)``."""
    entries = [F.struct(F.lit(f).alias("field_name"), F.col(f"fields.{f}").alias("expected")) for f in K.FIELDS]
    return manifest.select(F.col("doc_id").alias("document_id"), F.explode(F.array(*entries)).alias("e")).select(
        "document_id", "e.field_name", "e.expected"
    )


def same_value(a: Column, b: Column) -> Column:
    plain = lambda v: F.lower(X.strip(F.coalesce(v, F.lit(""))))
    return plain(a) == plain(b)


def field_hits(truth: DataFrame, fields: DataFrame) -> DataFrame:
    """Each true field with whether the extracted one equals it, blanks and case apart; two nulls are equal."""
    found = fields.select("document_id", "field_name", "field_value")
    return truth.join(found, ["document_id", "field_name"], "left").select(
        "document_id", "field_name", same_value(F.col("field_value"), F.col("expected")).alias("hit")
    )


def field_accuracy(hits: DataFrame) -> DataFrame:
    return hits.agg(
        F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total"), F.avg(F.col("hit").cast("double")).alias("accuracy")
    )


def expected_rules(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Each document's expected rule with whether it ``fired``: gave anything but pass."""
    expected = manifest.filter(F.coalesce("expected_failing_rule", F.lit("")) != "").select(
        F.col("doc_id").alias("document_id"), F.col("expected_failing_rule").alias("rule_name")
    )
    fired = results.groupBy("document_id", "rule_name").agg(F.max(F.col("result") != "pass").alias("fired"))
    return expected.join(fired, ["document_id", "rule_name"], "left")


def rule_catches(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Caught and total per expected rule, and in total (rule null): caught when the rule gave anything but pass."""
    return expected_rules(manifest, results).rollup("rule_name").agg(
        F.count_if("fired").alias("caught"), F.count(F.lit(1)).alias("total")
    )


def score(manifest: DataFrame, fields: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """Field accuracy, catch rates and the automatic decisions for a processed sample set."""
    from veriloom.operators import rules

    return {
        "accuracy": field_accuracy(field_hits(truth_fields(manifest), fields)),
        "catches": rule_catches(manifest, results),
        "decisions": rules.auto_decision(results),
    }


def run_summary(manifest: DataFrame, fields: DataFrame, results: DataFrame, path: str) -> DataFrame:
    """Write the scored fields and rules of a batch run under ``path``; one row of totals read off those two jobs.

    ``path/fields`` has every true field with its hit, ``path/rules`` every expected rule with whether it fired. The totals
    are metrics observed while these are written, so nothing is computed a second time. An empty run has totals of zero.
    """
    of_fields, of_rules = Observation(), Observation()
    hits = field_hits(truth_fields(manifest), fields).observe(
        of_fields, F.count_if(F.col("field_name") == K.FIELDS[0]).alias("ingested"),
        F.count_if("hit").alias("field_hits"), F.count(F.lit(1)).alias("field_total"),
    )
    hits.write.mode("overwrite").parquet(f"{path}/fields")
    caught = expected_rules(manifest, results).observe(
        of_rules, F.count_if("fired").alias("rule_hits"), F.count(F.lit(1)).alias("rule_total")
    )
    caught.write.mode("overwrite").parquet(f"{path}/rules")
    seen = of_fields.get | of_rules.get
    names = ["ingested", "field_hits", "field_total", "rule_hits", "rule_total"]
    return manifest.sparkSession.createDataFrame([tuple(seen[n] for n in names)], ", ".join(f"{n} bigint" for n in names))
