"""Quality by importance resampling: how likely a text is under a target model against a raw one, then Gumbel top-k.

Both models are generative models of n-grams hashed into ``BUCKETS`` buckets: of words, of word pairs, and of the
shapes of three neighbouring words (case, marks, digits, repetition). The raw model counts all documents; the target
model a bounded sample of documents labelled good (``TARGET_SAMPLE``). A document's log weight is the sum of the log
ratios of its n-grams. Adding a Gumbel variable to each and keeping the ``k`` largest draws ``k`` documents without
replacement in proportion to their weights. ``k`` is the number of documents whose mean log ratio is at least a
threshold calibrated on labelled documents.

Gumbel variables come from a hash of the id, so a task that is run again draws the same. The k-th key is found by
histograms; no ranking passes through one task.

Defined results: null and blank texts have log weight zero and no n-grams, and count as good; without labels all
documents are kept; equal keys at the border are all kept; repeated rows draw the same variable; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import kth_largest, remainder, stored, table, whole_texts

BUCKETS = 1 << 16
TARGET_SAMPLE = 20_000
CALIBRATION_SAMPLE = 4_000
SMOOTHING = 1.0
PRIOR_SHARE = 0.1
#: Numbers of words met by the running task; forgotten when it ends, as workers outlive it.
WORDS: dict[str, int] = {}
KNOWN_WORDS = 200_000


def _shape(word: str) -> int:
    """A small number for case, digits and marks of a word."""
    letters = word.strip("-'.,;:!?()\"")
    if not letters:
        kind = 0
    elif letters.isalpha():
        kind = 1 if letters.islower() else 2 if letters.isupper() and len(letters) > 1 else 3 if letters[0].isupper() else 4
    elif letters.isdigit():
        kind = 5
    else:
        kind = 6 if letters.isalnum() else 7
    tail = word[-1] if not word[-1].isalnum() else "a"
    return kind * 131 + ord(tail) % 128


def ngrams(texts: Iterable[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of some texts, one row per word, and where each text's rows begin.

    A row has three numbers: of the word, of the pair and of the shapes of the triple that end there; what precedes a
    text are two blanks. ``buckets`` is a power of two.
    """
    if len(WORDS) > KNOWN_WORDS:
        WORDS.clear()
    words: list[str] = []
    starts = []
    for text in texts:
        words += ("", "")
        starts.append(len(words))
        words += (text or "").split()
    starts = np.array(starts, np.int64)
    n = len(words)
    try:
        packed = np.fromiter(map(WORDS.__getitem__, words), np.uint64, n)
    except KeyError:
        for word in words:
            if word not in WORDS:
                WORDS[word] = (_shape(word) << 32 | zlib.crc32(word.encode("utf-8", "replace"))) if word else 8191 << 32
        packed = np.fromiter(map(WORDS.__getitem__, words), np.uint64, n)
    hashed, shapes = packed & np.uint64(0xFFFFFFFF), packed >> np.uint64(32)
    shapes[1:] += np.uint64(16384) * (hashed[1:] == hashed[:-1])
    shapes[2:] += np.uint64(32768) * (hashed[2:] == hashed[:-2])
    mix = np.uint64(0x9E3779B97F4A7C15)
    found = np.zeros((n, 3), np.uint64)
    found[:, 0] = (hashed + np.uint64(1)) * mix
    found[1:, 1] = (hashed[1:] * mix + hashed[:-1] * np.uint64(3)) * mix + np.uint64(2)
    found[2:, 2] = ((shapes[2:] * mix + shapes[1:-1]) * mix + shapes[:-2]) * mix + np.uint64(5)
    keep = np.ones(n, bool)
    keep[starts - 1] = keep[starts - 2] = False
    found = found[keep]
    found ^= found >> np.uint64(29)
    found *= mix
    found >>= np.uint64(40)
    return found.astype(np.int64) & (buckets - 1), starts - 2 * np.arange(1, len(starts) + 1)


def _blocks(texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """Texts in groups of about ``chars`` characters; a longer text is a group of its own."""
    block: list[str | None] = []
    size = 0
    for text in texts:
        block.append(text)
        size += len(text or "")
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _counts(texts: DataFrame) -> np.ndarray:
    """N-gram counts over all rows of a column ``text``; a table of ``BUCKETS`` numbers at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for block in _blocks(batch["text"]):
                total += np.bincount(ngrams(block)[0].ravel(), minlength=BUCKETS)
        WORDS.clear()
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found, "n": total[found]})

    rows = texts.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS)
    counts[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return counts


def weighted(documents: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``documents`` with ``log_weight`` and ``n_grams``.

    Filters on them stay above them: one that is moved below runs the function a second time in the same task, and each
    core then holds two Python workers for as long as the executor lives.
    """

    @F.pandas_udf("log_weight double, n_grams long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
            for block in _blocks(batch):
                found, starts = ngrams(block)
                running = np.concatenate([[0.0], np.cumsum(ratio[found].sum(axis=1))])
                stops = np.append(starts[1:], len(found))
                sums.append(running[stops] - running[starts])
                sizes.append(3 * (stops - starts))
            yield pd.DataFrame({"log_weight": np.concatenate(sums), "n_grams": np.concatenate(sizes)})
        WORDS.clear()

    return documents.withColumn("_w", run.asNondeterministic()(F.col("text"))).withColumns({"log_weight": F.col("_w.log_weight"), "n_grams": F.col("_w.n_grams")}).drop("_w")


def _sample(labels: DataFrame, quality: int, size: int, target: bool) -> DataFrame:
    """Labelled ids, three fifths of them for the target model and the rest to calibrate it on texts it has not met."""
    rows = labels.filter("doc_id is not null").filter(F.col("quality") == quality).filter(remainder("doc_id", 4) != 2)
    rows = rows.filter((F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)) < 3) == F.lit(target))
    return rows.select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id").limit(size)


def fit(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The log ratio per bucket and the least mean log ratio of a good document."""
    good = documents.select("doc_id", "text").join(F.broadcast(_sample(labels, 1, TARGET_SAMPLE, True)), "doc_id")
    target, raw = _counts(good), _counts(documents)
    if not target.sum():
        return np.zeros(BUCKETS), -math.inf
    raw_share = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    # the target model is smoothed towards the raw one: a bucket it has not met enough keeps a ratio near one
    strength = PRIOR_SHARE * target.sum() * raw_share
    target_share = (target + strength) / (target.sum() + strength.sum())
    ratio = np.log(target_share / raw_share)
    known = _sample(labels, 1, CALIBRATION_SAMPLE, False).unionByName(_sample(labels, 0, CALIBRATION_SAMPLE, False))
    measured = weighted(documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "quality"), ratio)
    rows = measured.filter("n_grams > 0").select("quality", (F.col("log_weight") / F.col("n_grams")).alias("mean")).toPandas()
    kinds = [np.sort(rows.loc[rows["quality"] == k, "mean"].to_numpy(float)) for k in (0, 1)]
    if not len(kinds[0]) or not len(kinds[1]):
        return ratio, -math.inf
    # clean documents lost weigh more than junk kept
    points = np.concatenate(kinds)
    lost = np.searchsorted(kinds[1], points, "left") / len(kinds[1])
    passed = 1 - np.searchsorted(kinds[0], points, "left") / len(kinds[0])
    return ratio, float(points[np.argmin(3 * lost + passed)])


def resampled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, log_weight, n_grams, key, selected)`` for each row of ``documents``."""
    ratio, least = fit(documents, labels)
    marked = weighted(documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), ratio).drop("text")
    draw = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("gumbel")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    # measured from the border, so that the sampling compares like with like whatever a text's length
    border = F.col("log_weight") - (F.lit(least) * F.col("n_grams") if math.isfinite(least) else F.lit(0.0))
    marked = stored(marked.withColumn("good", (F.col("n_grams") == 0) | (border >= 0)).withColumn("key", border - F.log(-F.log(draw))))
    lowest = kth_largest(marked, "key", marked.filter("good").count())
    selected = F.lit(True) if not math.isfinite(least) else F.col("key") >= F.lit(math.inf if lowest is None else lowest)
    return marked.drop("good").withColumn("selected", selected)


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampled(documents, table(spark, sf_dir, "labels")).drop("text_hash")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents drawn."""
    whole_texts(spark)
    drawn = resampled(docs, table(spark, sf_dir, "labels")).filter("selected").select("doc_id", "text_hash").distinct()
    left, right = docs.alias("d"), drawn.alias("k")
    same = F.expr("d.doc_id <=> k.doc_id AND xxhash64(d.text) = k.text_hash")
    return left.join(right, same, "left_semi").select(*[F.col(f"d.{n}") for n in docs.columns])
