"""Toxicity by compression distance: windows of a text against a toxic and an ordinary zstandard dictionary.

Training, on a bounded sample of labelled rows (``TOXIC_SAMPLE`` and ``ORDINARY_SAMPLE`` documents, in pieces of at
most ``PIECE_CHARS`` characters):

1. The ordinary dictionary is trained on windows of ordinary text.
2. The toxic dictionary is trained on toxic text for what the ordinary one lacks. A word enters if it holds byte
   sequences that toxic texts have in significantly more different contexts than ordinary ones do. Contexts, not
   occurrences, are counted, so a passage copied into many documents weighs no more than once.
3. Both share the ordinary content and have the same size, so windows of ordinary text compress to the same length.

Each window of a text gets a gain: its length under the ordinary dictionary less that under the toxic one. How likely a
gain is in toxic and in ordinary documents is learnt from a second bounded sample (``CALIBRATION_SAMPLE`` whole
documents); a document's log-likelihood ratio over all its windows, and how many gains are large, are turned into a
probability by a logistic fit.

Defined results: null and blank texts are scored as texts without windows; without labels of both kinds the score is
the share of toxic labels, or zero; a null id counts as not held out; repeated rows are scored each; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import remainder, table, whole_texts

WINDOW_BYTES = 64
LEVEL = 7
SHARED_BYTES = 4096
OWN_BYTES = 4096
GRAM = 5
PIECE_CHARS = 8192
TOXIC_SAMPLE = 2000
ORDINARY_SAMPLE = 4000
CALIBRATION_SAMPLE = 3000
TRAINING_WINDOWS = 20_000
SPAN = 20
LARGE_GAIN = 3
THRESHOLD = 0.3


def windows(text: str | None, size: int = WINDOW_BYTES) -> list[bytes]:
    """Whole words up to ``size`` bytes; longer words are cut."""
    out: list[bytes] = []
    current: list[bytes] = []
    used = 0
    for word in (text or "").lower().encode("utf-8", "replace").split():
        need = len(word) + 1
        if used + need > size and current:
            out.append(b" " + b" ".join(current))
            current, used = [], 0
        if need > size:
            out += [word[i : i + size] for i in range(0, len(word), size)]
            continue
        current.append(word)
        used += need
    if current:
        out.append(b" " + b" ".join(current))
    return out


def _contexts(texts: list[str]) -> tuple[Counter, int]:
    """In how many different neighbourhoods each word occurs, and how many neighbourhoods there are.

    Words are numbered and neighbourhoods are rows of three numbers, as objects they would take most of the driver's memory.
    """
    names: dict[bytes, int] = {b"": 0}
    found = [np.zeros((0, 3), np.int32)]
    for text in texts:
        words = [w.strip(b".,!?;:") for w in text.lower().encode("utf-8", "replace").split()]
        at = np.array([0, *(names.setdefault(w, len(names)) for w in words), 0], np.int32)
        found.append(np.stack([at[:-2], at[1:-1], at[2:]], axis=1))
    seen = np.concatenate(found)
    seen = seen[np.lexsort(seen.T)]
    seen = seen[np.append(True, (seen[1:] != seen[:-1]).any(axis=1))[: len(seen)]]
    counts = np.bincount(seen[:, 1], minlength=len(names)).tolist()
    return Counter({word: n for word, n in zip(names, counts, strict=True) if n}), len(seen)


def _grams(word: bytes) -> set[bytes]:
    padded = b" " + word
    return {padded[i : i + GRAM] for i in range(max(1, len(padded) - GRAM + 1))}


def distinctive(texts: list[str], others: list[str]) -> list[bytes]:
    """Words of ``texts`` that add byte sequences significantly more frequent there than in ``others``, best last."""
    words, n = _contexts(texts)
    other_words, m = _contexts(others)
    here: Counter = Counter()
    there: Counter = Counter()
    for counts, grams in ((words, here), (other_words, there)):
        for word, k in counts.items():
            for gram in _grams(word):
                grams[gram] += k
    strong = {
        g for g, k in here.items()
        if (k - 2.5 * k**0.5) / max(n, 1) >= 2 * (there[g] + 0.5 + 2.5 * there[g] ** 0.5) / max(m, 1) and k >= 4
    }
    chosen, covered = [], set()
    for word in sorted(words, key=lambda w: (-words[w], w)):
        found = _grams(word) & strong if 3 < len(word) <= 64 else set()
        if found and not found & covered:
            chosen.append(word)
        covered |= found
    return chosen[::-1]


class Model:
    """Two dictionaries, the likelihoods of gains and the logistic weights; small, so it is sent with the code."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = toxic, ordinary
        self.ratio = np.zeros(2 * SPAN + 1)
        self.weights = np.array([-9.0, 0.0, 0.0, 0.0])
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self):
        if self._ready is None:
            self._ready = []
            for content in (self.ordinary, self.toxic):
                form = zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, source_size=2 * WINDOW_BYTES, dict_size=max(len(content), 8), format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                    write_content_size=0, write_checksum=0, write_dict_id=0,
                )
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(compression_params=form)
                self._ready.append(zstandard.ZstdCompressor(dict_data=known, compression_params=form).compress)
        return self._ready

    def gains(self, text: str | None) -> np.ndarray:
        """How often each gain occurs among the windows of a text, as counts of ``-SPAN`` to ``SPAN``."""
        ordinary, toxic = self._compressors()
        counts = np.zeros(2 * SPAN + 1, np.int64)
        for window in windows(text):
            counts[max(-SPAN, min(SPAN, len(ordinary(window)) - len(toxic(window)))) + SPAN] += 1
        return counts

    def features(self, counts: np.ndarray) -> np.ndarray:
        counts = np.atleast_2d(counts)
        return np.column_stack([
            np.ones(len(counts)), np.clip(counts @ self.ratio, -30, 30) / 4,
            np.log1p(counts[:, SPAN + LARGE_GAIN :].sum(axis=1)), np.log1p(counts.sum(axis=1)),
        ])

    def calibrate(self, counts: np.ndarray, labels: np.ndarray) -> None:
        share = float(labels.mean()) if len(labels) else 0.0
        if not 0 < share < 1:
            self.ratio[:] = 0
            self.weights = np.array([np.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0, 0.0])
            return
        # smoothed with what both kinds have in common, so a gain seen once does not decide
        common = counts.sum(axis=0) + 0.5
        common = common / common.sum()
        kinds = [counts[labels == k].sum(axis=0) + 20 * common for k in (0, 1)]
        zero, one = (k / k.sum() for k in kinds)
        self.ratio = np.log(one / zero)
        x = self.features(counts)
        w = np.zeros(x.shape[1])
        pull = np.diag([1e-3, 0.3, 0.3, 0.3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (labels - p) - pull @ w)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, text: str | None) -> float:
        value = float((self.features(self.gains(text)) @ self.weights)[0])
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, value)))))


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    own = b" " + b" ".join(distinctive(toxic, ordinary)) + b" "
    own = own[-OWN_BYTES:]
    step = max(1, sum(len(windows(t)) for t in ordinary) // TRAINING_WINDOWS)
    samples = list(islice((w for t in ordinary for w in windows(t)), 0, None, step))
    try:
        shared = zstandard.train_dictionary(SHARED_BYTES + 2048, samples).as_bytes()[-SHARED_BYTES:]
    except zstandard.ZstdError:  # too little text to train on: the text itself
        shared = b"".join(samples)[-SHARED_BYTES:]
    filler = b"".join(samples[:200])[: len(own)].ljust(len(own))
    return Model(own + shared, filler + shared)


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The two dictionaries from all sampled pieces, whose number has a bound: in a task, as the driver would keep their memory for good."""
    kinds: dict[int, list[tuple]] = {1: [], 0: []}
    for batch in batches:
        for toxic, *piece in zip(*(batch[c].tolist() for c in ("toxic", "at", "doc_id", "start", "text")), strict=True):
            kinds[toxic].append(tuple(piece))
    found = train_dictionaries(*([piece[-1] for piece in sorted(kinds[k])] for k in (1, 0)))
    yield pd.DataFrame({"toxic": [found.toxic], "ordinary": [found.ordinary]})


def fit(
    documents: DataFrame,
    labels: DataFrame,
    toxic_sample: int = TOXIC_SAMPLE,
    ordinary_sample: int = ORDINARY_SAMPLE,
    calibration_sample: int = CALIBRATION_SAMPLE,
) -> Model:
    """Train on labelled documents whose remainder is not 2; samples are taken by a hash of the id."""
    known = (
        labels.filter("doc_id is not null and toxic in (0, 1)").filter(remainder("doc_id", 4) != 2)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)) < 3)
    )
    order = F.xxhash64("doc_id", F.lit("order"))
    sizes = [(True, 1, toxic_sample), (True, 0, ordinary_sample), (False, 1, calibration_sample), (False, 0, calibration_sample)]
    chosen = None
    for part, toxic, size in sizes:
        rows = known.filter((F.col("part") == part) & (F.col("toxic") == toxic)).orderBy(order, "doc_id").limit(size)
        chosen = rows if chosen is None else chosen.unionByName(rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    train = texts.filter("part").select("toxic", "text", "doc_id")
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(PIECE_CHARS))
    pieces = train.filter("text is not null").withColumn("start", F.explode(starts))
    pieces = pieces.select("toxic", "doc_id", "start", F.expr(f"substring(text, start, {PIECE_CHARS})").alias("text"))
    order_of_pieces = F.xxhash64("doc_id", "start")
    taken = None
    for toxic, size in ((1, toxic_sample), (0, ordinary_sample)):
        rows = pieces.filter(F.col("toxic") == toxic).withColumn("at", order_of_pieces).orderBy("at", "doc_id", "start", "text").limit(size)
        taken = rows if taken is None else taken.unionByName(rows)
    trained = taken.coalesce(1).mapInPandas(_train, "toxic binary, ordinary binary").collect()
    model = Model(bytes(trained[0]["toxic"]), bytes(trained[0]["ordinary"])) if trained else train_dictionaries([], [])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "gains": [model.gains(t).tolist() for t in batch["text"]]})

    rest = texts.filter("not part").select("toxic", "text", "doc_id").orderBy(order, "doc_id").limit(2 * calibration_sample)
    measured = rest.select("toxic", "text").mapInPandas(measure, "toxic int, gains array<long>").collect()
    counts = np.array([r["gains"] for r in measured], np.int64).reshape(-1, 2 * SPAN + 1)
    model.calibrate(counts, np.array([r["toxic"] for r in measured], float))
    return model


def _scores(model: Model):
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return run


def scored(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with columns ``toxicity`` and ``toxic_predicted``."""
    marked = documents.withColumn("toxicity", _scores(model)(F.col("text")))
    return marked.withColumn("toxic_predicted", F.when(F.col("toxicity") >= threshold, 1).otherwise(0))


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return scored(documents, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"), F.col("toxic_predicted").alias("predicted"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic. Any columns stay as they are, those named like scores too."""
    whole_texts(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(_scores(model)(F.col("text")) < THRESHOLD)
