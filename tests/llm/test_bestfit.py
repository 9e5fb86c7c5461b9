"""Best-fit packing: exact token round trip, room, gaps, number of sequences, rounds against any partitioning."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veriloom.llm import bestfit as B

PATH = public_tokenizers.path(B.TOKENIZER)
PARTS = ["a", "été", "Wort", " ", "  ", "   ", "\n", "\n ", " \n", "\t", "'s", "12", "中文", "é", "!?", chr(0x200B), "\x85", chr(0x3000), "\x1f", "<|endoftext|>", "🙂", "x" * 60, "."]


def plain(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, B.CLOSING_ID]


def test_words_encoded_apart_give_the_ids_of_the_whole_text():
    rng = random.Random(2)
    tokenizer, encode = Tokenizer.from_file(PATH), B.ByteEncoder(PATH, cache_words=300)
    texts = ["", " ", "  ", "x  ", "x \n ", "  x", " \x85 x"]
    texts += ["".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(3000)]
    texts += [" ".join(rng.choices(PARTS[:3] + PARTS[10:15], k=rng.randint(1, 60))) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check(rows, limit):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.size))
    for placed in sequences.values():
        at = 0
        for offset, size in sorted(placed):
            assert offset == at
            at += size
        assert at <= limit
    return len(sequences)


def decreasing(sizes, limit):
    """Sequences that best fit over falling sizes needs, one item after another."""
    gaps = []
    for size in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            gaps.append(limit - size)
    return len(gaps)


@pytest.mark.parametrize("kind", ["uniform", "small", "equal", "halves", "mixed", "large", "ones"])
@pytest.mark.parametrize("rows_per_task", [60, 100_000])
def test_rounds_fill_sequences_like_falling_best_fit(spark, kind, rows_per_task):
    rng = random.Random(kind)
    n, limit = 500, 100
    sizes = {
        "uniform": lambda: rng.randint(1, limit), "small": lambda: rng.randint(1, 9), "equal": lambda: 7, "halves": lambda: rng.choice([50, 51, 49]),
        "mixed": lambda: rng.choice([100, 3, rng.randint(1, limit), 34]), "large": lambda: rng.randint(40, limit), "ones": lambda: 1,
    }[kind]
    sizes = [sizes() for _ in range(n)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    rows = B.pack(items, limit, rows_per_task).join(items, "item").collect()
    assert sorted(r.item for r in rows) == list(range(n))
    assert check(rows, limit) <= 1.02 * decreasing(sizes, limit) + 1


def test_left_over_items_are_dealt_by_rank():
    # two ranges of items, then gaps of 25 for items of at most 10 (two each), then more gaps than items
    runs = B.deal([(0, 3, 5, 0, 0), (1, 5, 10, 0, 0), (2, 0, 0, 2, 25), (3, 2, 40, 4, 50)])
    assert runs == [(1, 0, 2, 0, 2, 2), (1, 4, 3, 0, 1, 5), (0, 0, 3, 1, 1, 10)]
    assert B.deal([(0, 0, 0, 4, 9), (1, 4, 9, 0, 0)]) == []


def test_documents_null_empty_long_repeated_and_clashing(spark):
    rng = random.Random(6)
    long = " ".join(rng.choices(["alpha", "beta", "gamma"], k=9000))
    docs = [(1, None), (2, ""), (3, "one"), (None, "two words"), (None, "two words"), (4, long), (4, long)] + [
        (10 + i, " ".join(rng.choices(["so", "it", "is", "Überall"], k=rng.randint(1, 900)))) for i in range(60)
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit("x")).withColumn("item", F.lit("y"))
    rows = B.best_fit(df.repartition(3)).withColumn("size", F.col("length")).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for doc_id, text in docs:
        ids = plain(tokenizer, text)
        first = (len(ids) - 1) % B.LIMIT + 1
        cuts = [0, *range(first, len(ids) + 1, B.LIMIT)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    assert check(rows, B.LIMIT) <= -(-sum(r.length for r in rows) // B.LIMIT) + 2
    assert B.best_fit(df.limit(0)).collect() == []
