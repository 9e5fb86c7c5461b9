"""Language-model scores from log-frequency Bloom filters of the quantised counts of all pairs of tokens.

Tokens are words and one end per text. Token counts are exact and over all training texts. New tokens have the share of
tokens met once (Good-Turing); known ones share the rest by their counts: ``p(b)``. After a token ``a`` the probability is
``(c(a,b) + PRIOR * p(b)) / (c(a) + PRIOR)``; a text's first token has no context. The score is a sum over tokens plus
``log10(1 + c(a,b) / (PRIOR * p(b)))`` for each pair that was met, so only pairs ever have to be looked up.

Pairs of all training texts are counted, so what is gathered grows with the corpus. Counts are quantised downwards to
powers of ``BASE``; a count of level ``q`` is entered in a Bloom filter under levels 1 to ``q`` and read by probing level
after level until a probe misses. Pairs that are at least one in ``HEAD_PAIRS`` of all tokens, so at most that many, are in
a filter that is broadcast. All others are in filters of hash shards, each for about ``SHARD_TOKENS`` tokens of the corpus;
a shard's filter and the pairs that texts ask of it meet in one partition, filter first, and pairs stream past it. A pair
outside the head is rare by that rule, so no shard is hot. What shards find travels packed, one row for each shard of texts
and buffer, and is added up where the texts of that shard are.

Quantised counts and the rounding up of ``p(b)`` within a pair's term only lower a probability, so the probabilities after
a context sum to at most one but for false positives (under one probe in a thousand).

Frequent tokens (at most ``FREQUENT``, by a threshold on their count) are sent to the workers and scored where the text
is; only the others are shuffled, one row per text and token, to meet their counts.

Texts are read in two passes whose rows carry ``row`` numbers that have to agree, so ``documents`` has to come from a
stored table. Defined results: null and blank texts are one end token; a null id counts as not held out; invalid
characters are replaced; repeated rows are scored each; with no training text every token is new; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import threading
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import remainder, stored, table, whole_texts

PRIOR = 200.0
BASE = 1.5
FINE = 1.15
HASHES = 6
BITS_PER_ENTRY = 16
HEAD_PAIRS = 1 << 16
SHARD_TOKENS = 1 << 21
FREQUENT = 1 << 17
SMOOTHING = 0.1
END = b""
FLUSH_TOKENS = 400_000
FLUSH_PAIRS = 2_000_000
FLUSH_PROBES = 200_000
FLUSH_SUMS = 400_000
PROBED = 1 << 16
GROUP_TOKENS = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)
LOW, HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A to Z lower-cased, then the end."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    found.append(END)
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def pair_key(before: np.ndarray, after: np.ndarray, shards: int) -> np.ndarray:
    """One number for a pair of token hashes, in order. Its high half is the shard, its low half names the pair there."""
    x = _mixed(_mixed(before * MIX) + after)
    return ((x >> HALF) % np.uint64(shards)) << HALF | x & LOW


def level(count: np.ndarray, base: float = BASE, up: bool = False) -> np.ndarray:
    """The quantised logarithm of positive counts: 1 for one, then one more for each factor of ``base``."""
    q = np.log(np.maximum(count, 1)) / math.log(base)
    return (np.ceil(q - 1e-9) if up else np.floor(q + 1e-9)).astype(np.int64) + 1


def value(levels: np.ndarray) -> np.ndarray:
    """The least count of a level; zero for level zero."""
    return np.where(levels > 0, np.ceil(BASE ** (levels - 1.0) - 1e-9), 0.0)


class LogBloom:
    """A Bloom filter of pairs of a key and a level, as large as its entries ask for."""

    def __init__(self, words: bytes):
        self.words = np.frombuffer(words, np.uint8)
        self.mask = np.uint64(len(words) * 8 - 1)

    @classmethod
    def of(cls, keys: np.ndarray, levels: np.ndarray) -> LogBloom:
        bits = 1 << max(10, (int(levels.sum()) * BITS_PER_ENTRY).bit_length())
        found = np.zeros(bits, bool)
        for at in range(1, int(levels.max(initial=0)) + 1):
            for spot in cls._spots(keys[levels >= at], at, np.uint64(bits - 1)):
                found[spot] = True
        return cls(np.packbits(found, bitorder="little").tobytes())

    @staticmethod
    def _spots(keys: np.ndarray, at: int, mask: np.uint64) -> Iterator[np.ndarray]:
        seed = _mixed(keys.astype(np.uint64) * MIX + np.uint64(at))
        second = _mixed(seed + MIX) | np.uint64(1)
        for i in range(HASHES):
            yield (seed + np.uint64(i) * second) & mask

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level for which it and all below it are present."""
        found = np.zeros(len(keys), np.int64)
        alive, at = np.arange(len(keys)), 0
        while len(alive):
            at += 1
            seed = _mixed(keys[alive].astype(np.uint64) * MIX + np.uint64(at))
            second = _mixed(seed + MIX) | np.uint64(1)
            for i in range(HASHES):
                spot = (seed + np.uint64(i) * second) & self.mask
                held = (self.words[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                alive, seed, second = alive[held], seed[held], second[held]
            found[alive] = at
        return found


def vocabulary(texts: DataFrame) -> DataFrame:
    """``(token, c, h)`` for every token of ``texts``: its count and its hash.

    Workers count tokens in bounded tables and pass them on, so what is shuffled is counted beforehand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens(text.as_py()))
                if len(counts) > FLUSH_TOKENS:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    counted = texts.select("text").mapInArrow(run, "token binary, c long")
    return counted.groupBy("token").agg(F.sum("c").alias("c")).withColumn("h", F.xxhash64("token"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "c"])


def _threshold(words: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` tokens have at least this count."""
    rows = words.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, 0
    for row in sorted(rows, key=lambda r: -r["p"]):
        total += row["n"]
        if total > most:
            return 1 << (row["p"] + 1)
        least = row["p"]
    return 1 << least


def _hash(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, 42)


def _read(texts: pa.Array, rank: dict[bytes, int], hashes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about ``GROUP_TOKENS`` tokens, each text whole.

    Bounds of the group in the batch; for each token its text's number in the group, its rank (zero if not frequent) and
    its hash; for each token but the first whether it follows one of the same text.
    """
    get = rank.get
    start, found, lengths = 0, [], []
    for i, text in enumerate(texts):
        words = tokens(text.as_py())
        found += words
        lengths.append(len(words))
        if len(found) < GROUP_TOKENS and i + 1 < len(texts):
            continue
        place = np.repeat(np.arange(len(lengths)), lengths)
        at = np.fromiter([get(t, 0) for t in found], np.int64, len(found))
        h = hashes[at]
        rare = np.flatnonzero(at == 0)
        h[rare] = np.fromiter([_hash(found[k]) for k in rare.tolist()], np.uint64, len(rare))
        yield start, i + 1, place, at, h, place[1:] == place[:-1]
        start, found, lengths = i + 1, [], []


class _Codec(threading.local):
    """Entropy coding, which the compression of Spark's shuffle lacks."""

    def __init__(self):
        self.packed, self.unpacked = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


_CODEC = _Codec()


def _packed(data: bytes) -> bytes:
    return _CODEC.packed(data)


def _unpacked(data: bytes) -> bytes:
    return _CODEC.unpacked(data)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, first all lowest bytes, then the next: the constant high ones compress to nothing."""
    return _packed(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _rising(numbers: np.ndarray) -> bytes:
    """Planes of the steps from each number to the next, small where the numbers rise; any numbers can be packed."""
    return _planes(np.diff(numbers.astype(np.int64), prepend=0))


def _from_rising(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data))


def _by_shard(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the keys by shard, stable, and for each shard its number and the bounds of its slice."""
    shard = (keys >> HALF).astype(np.int64)
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    ordered = shard[order]
    if not len(ordered):
        return order, []
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return order, [(int(ordered[s]), int(s), int(e)) for s, e in zip(starts, np.append(starts[1:], len(ordered)), strict=True)]


_COUNTS = "shard int, keys binary, counts binary"
_FILTERS = "shard int, words binary, head binary, head_counts binary"


def _pair_filters(texts: DataFrame, held, shards: int, least: int) -> DataFrame:
    """One row per shard: the filter of its pairs below ``least``, and the keys and counts of the others.

    Tasks count pairs in bounded buffers and pass on, for each shard, distinct keys with counts: 32 bits a key there.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hashes = held.value[0], held.value[1]
        buffer: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, _, _, _, h, inner in _read(batch.column(0), rank, hashes):
                buffer.append(pair_key(h[:-1][inner], h[1:][inner], shards))
                size += len(buffer[-1])
                if size > FLUSH_PAIRS:
                    yield rows(buffer)
                    buffer, size = [], 0
        yield rows(buffer)

    def rows(buffer: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(buffer) if buffer else np.zeros(0, np.uint64), return_counts=True)
        slices = _by_shard(keys)[1]  # distinct keys come in order
        return pa.RecordBatch.from_arrays([
            pa.array([s for s, _, _ in slices], pa.int32()), pa.array([_rising(keys[a:b] & LOW) for _, a, b in slices], pa.binary()),
            pa.array([_planes(n[a:b]) for _, a, b in slices], pa.binary()),
        ], names=["shard", "keys", "counts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts = None, [], []
        for batch in batches:
            for shard, key, n in zip(*[batch.column(i) for i in range(3)], strict=True):
                if at is not None and shard.as_py() != at:
                    yield built(at, keys, counts)
                    keys, counts = [], []
                at = shard.as_py()
                keys.append(_from_rising(key.as_py()).astype("<u4"))
                counts.append(_from_planes(n.as_py()))
        if at is not None:
            yield built(at, keys, counts)

    def built(shard: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)
        tail = n < least
        bloom = LogBloom.of(key[tail], level(n[tail]))
        top = np.uint64(shard) << HALF | key[~tail].astype(np.uint64)
        return pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), pa.array([bloom.words.tobytes()], pa.binary()),
            pa.array([top.astype("<u8").tobytes()], pa.binary()), pa.array([_planes(n[~tail])], pa.binary()),
        ], names=["shard", "words", "head", "head_counts"])

    counted = texts.select("text").mapInArrow(count, _COUNTS)
    return counted.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(build, _FILTERS)


_ROWS = "row long, doc_id long, held_out boolean, doc_tokens long, known long, base double, model double"
_MIXED = "shard int, kind int, a binary, b binary, c binary, " + _ROWS
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
FILTER, PROBES, TEXTS, SUMS = 0, 1, 2, 3


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(p.split()[0], _TYPES[p.split()[1]]) for p in ddl.split(", ")])


def _filled(ddl: str, n: int, columns: dict) -> pa.RecordBatch:
    """``n`` rows with the given columns; the others are null."""
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([
        pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema
    ], schema=schema)


class _Lookup:
    """Pairs of texts: those of the head are answered here, the others are packed for their shards."""

    def __init__(self, head: LogBloom, least: int, scale: float):
        self.head, self.floor, self.scale = head, int(level(np.array([least]))[0]), scale
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def gain(self, levels: np.ndarray, after: np.ndarray) -> np.ndarray:
        """log10 of how much likelier a pair's second token is by the pair's count; ``after`` are its count's levels."""
        return np.log10(1 + value(levels) / (PRIOR * self.scale * FINE ** (after - 1.0)))

    def add(self, rows: np.ndarray, keys: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Gains of the pairs in the head, zero for the others, which are kept for their shards."""
        different, place = np.unique(keys, return_inverse=True)
        levels = self.head.levels(different)[place]
        out = np.zeros(len(keys))
        known = levels >= self.floor
        out[known] = self.gain(levels[known], after[known])
        self.held.append((rows[~known], keys[~known], after[~known].astype(np.uint8)))
        self.size += int((~known).sum())
        return out

    def packed(self) -> pa.RecordBatch:
        rows, keys, after = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))
        self.held, self.size = [], 0
        if (np.diff(rows) < 0).any():
            order = np.argsort(rows, kind="stable")
            rows, keys, after = rows[order], keys[order], after[order]
        order, slices = _by_shard(keys)
        rows, low, after = rows[order], (keys[order] & LOW).astype("<u4"), after[order]
        return _filled(_MIXED, len(slices), {
            "shard": [s for s, _, _ in slices], "kind": [PROBES] * len(slices), "a": [_rising(rows[s:e]) for _, s, e in slices],
            "b": [low[s:e].tobytes() for _, s, e in slices], "c": [_packed(after[s:e].tobytes()) for _, s, e in slices],
        })


def scored(documents: DataFrame, trained: str = "trained", frequent: int = FREQUENT, shard_tokens: int = SHARD_TOKENS, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """One row per row of ``documents(doc_id, text, trained, held_out)`` with exact base and model scores."""
    spark = documents.sparkSession
    whole_texts(spark)
    context = spark.sparkContext
    words = stored(vocabulary(documents.filter(trained)))
    n_tokens, n_types, n_once = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1))
    ).first()
    new = min(0.5, max(n_once, 1) / (n_tokens + 1)) if n_tokens else 1.0
    total = n_tokens + SMOOTHING * (n_types + 1)
    scale = (1 - new) / max(n_tokens, 1)

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTHING) / total)

    def alone(c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, np.log10(np.maximum(scale * c, 1e-300)), math.log10(new))

    def as_context(c: np.ndarray) -> np.ndarray:
        return np.log10(PRIOR / (c + PRIOR))

    least = _threshold(words, frequent)
    common = words.filter(F.col("c") >= least).orderBy(F.desc("c"), "token").select("token", "c").toPandas()
    names, counts = [bytes(t) for t in common["token"]], common["c"].to_numpy(np.int64)

    def ranked(of: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, of.dtype), of])

    held = context.broadcast((
        {t: i + 1 for i, t in enumerate(names)}, ranked(np.array([_hash(t) for t in names], np.uint64)), ranked(base(counts)),
        ranked(alone(counts)), ranked(np.where([t == END for t in names], 0.0, as_context(counts))), ranked(level(counts, FINE, up=True)),
    ))
    shards = max(1, math.ceil(n_tokens / shard_tokens))
    often = max(2, math.ceil(n_tokens / head_pairs))
    filters = stored(_pair_filters(documents.filter(trained), held, shards, often))
    tops = filters.select("head", "head_counts").filter(F.length("head") > 0).collect()
    top_keys = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["head"], "<u8") for r in tops]])
    top_counts = np.concatenate([np.zeros(0, np.int64), *[_from_planes(bytes(r["head_counts"])) for r in tops]])
    head = context.broadcast(LogBloom.of(top_keys, level(top_counts)))

    def frequent_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hashes, base_of, alone_of, context_of, level_of = held.value
        lookup = _Lookup(head.value, often, scale)
        for batch in batches:
            for start, end, place, at, h, inner in _read(batch.column(3), rank, hashes):
                row, n = batch.column(0).to_numpy()[start:end], end - start
                asked = np.flatnonzero(inner & (at[1:] > 0))
                whose, after = place[1:][asked], at[1:][asked]
                gained = lookup.add(row[whose], pair_key(h[:-1][asked], h[1:][asked], shards), level_of[after])
                yield _filled(_MIXED, n, {
                    "shard": (row % shards).astype(np.int32), "kind": [TEXTS] * n, "row": row, "doc_id": batch.column(1)[start:end],
                    "held_out": batch.column(2)[start:end], "doc_tokens": np.bincount(place, minlength=n), "known": np.bincount(place[at > 0], minlength=n),
                    "base": np.bincount(place, base_of[at], n), "model": np.bincount(place, alone_of[at] + context_of[at], n) + np.bincount(whose, gained, n),
                })
                if lookup.size > FLUSH_PROBES:
                    yield lookup.packed()
        yield lookup.packed()

    rare_ddl = "row long, h long, key long, n long"

    def rare_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, hashes = held.value[0], held.value[1]
        for batch in batches:
            for start, _, place, at, h, inner in _read(batch.column(1), rank, hashes):
                key = np.full(len(h), -1, np.int64)  # a first token has no pair
                key[1:][inner] = pair_key(h[:-1][inner], h[1:][inner], shards).astype(np.int64)
                rare = np.flatnonzero(at == 0)
                columns = (batch.column(0).to_numpy()[start + place[rare]], h[rare].astype(np.int64), key[rare])
                order = np.lexsort(columns[::-1])
                columns = [x[order] for x in columns]
                new_one = np.append(True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1]))
                starts = np.flatnonzero(new_one[: len(order)])
                yield _filled(rare_ddl, len(starts), dict(zip(["row", "h", "key"], [x[starts] for x in columns], strict=True)) | {"n": np.diff(np.append(starts, len(order)))})

    def rare_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, end = _Lookup(head.value, often, scale), np.uint64(_hash(END)).astype(np.int64)
        sums: list[tuple] = []
        for batch in batches:
            row, h, key, n, c = (batch.column(i).to_numpy() for i in range(5))
            asked = np.flatnonzero((c > 0) & (key >= 0))
            place = np.repeat(asked, n[asked])
            gained = lookup.add(row[place], key[place].astype(np.uint64), level(c, FINE, up=True)[place])
            model = n * (alone(c) + np.where(h == end, 0.0, as_context(c))) + np.bincount(place, gained, len(row))
            sums.append((row, np.where(c > 0, n, 0), n * base(c), model))
            if lookup.size > FLUSH_PROBES:
                yield lookup.packed()
            if len(sums) * len(row) > FLUSH_SUMS:
                yield _summed(sums, shards)
                sums = []
        yield lookup.packed()
        if sums:
            yield _summed(sums, shards)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bloom, gains = None, None, _Lookup(LogBloom(bytes(1)), often, scale)
        sums, size = [], 0
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            passed = np.flatnonzero(kinds >= TEXTS)
            if len(passed):
                yield batch.take(pa.array(passed))
            waiting: list[tuple[bytes, bytes, bytes]] = []  # of one shard, looked up together: a slice alone can be a few pairs
            asked = 0
            for i in np.flatnonzero(kinds < TEXTS).tolist():
                shard, a = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if waiting and (kinds[i] == FILTER or shard != at or asked > PROBED):
                    sums.append(_met(bloom, gains, waiting))
                    size += len(sums[-1][0])
                    waiting, asked = [], 0
                if kinds[i] == FILTER:
                    at, bloom = shard, LogBloom(a)
                elif shard == at:  # a shard without a filter has no pairs
                    waiting.append((a, batch.column(3)[i].as_py(), batch.column(4)[i].as_py()))
                    asked += len(waiting[-1][1]) // 4
                if size > FLUSH_SUMS:
                    yield _summed(sums, shards)
                    sums, size = [], 0
            if waiting:
                sums.append(_met(bloom, gains, waiting))
                size += len(sums[-1][0])
        if sums:
            yield _summed(sums, shards)

    def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            shard, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, np.diff(shard) != 0)[: len(shard)])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)], strict=True):
                if of is None or of.shard != shard[start]:
                    if of is not None:
                        yield of.rows()
                    of = _Totals(shard[start])
                n = int((kinds[start:end] == TEXTS).sum())  # the texts of a shard come before its sums
                of.texts.append(batch.slice(start, n))
                for i in range(start + n, end):
                    of.add(*[batch.column(c)[i].as_py() for c in (2, 3, 4)])
        if of is not None:
            yield of.rows()

    numbered = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    first = numbered.mapInArrow(frequent_part, _MIXED)
    rare = numbered.select("row", "text").mapInArrow(rare_tokens, rare_ddl).join(words.filter(F.col("c") < least).select("h", "c"), "h", "left")
    second = rare.select("row", "h", "key", "n", F.coalesce("c", F.lit(0)).alias("c")).mapInArrow(rare_part, _MIXED)
    empty = [F.lit(None).cast(p.split()[1]).alias(p.split()[0]) for p in ("b binary, c binary, " + _ROWS).split(", ")]
    built = filters.select("shard", F.lit(FILTER).alias("kind"), F.col("words").alias("a"), *empty)
    together = first.unionByName(second).unionByName(built).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = together.mapInArrow(probe, _MIXED).repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(added_up, _ROWS)
    return found.select(
        "doc_id", "held_out", F.col("doc_tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"),
    )


def _met(bloom: LogBloom, gains: _Lookup, packed: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, ...]:
    """Rows, known tokens, base and gains of the packed pairs that the filter holds."""
    rows, keys, after = zip(*packed, strict=True)
    levels = bloom.levels(np.frombuffer(b"".join(keys), "<u4").astype(np.uint64))
    met = np.flatnonzero(levels)
    after = np.frombuffer(b"".join(_unpacked(c) for c in after), np.uint8)[met].astype(np.float64)
    whose = np.concatenate([_from_rising(a) for a in rows])[met]
    return whose, np.zeros(len(met), np.int64), np.zeros(len(met)), gains.gain(levels[met], after)


class _Totals:
    """The texts of one shard by their number, and what is added to them."""

    def __init__(self, shard: int):
        self.shard, self.texts, self.order = shard, [], None

    def _ready(self) -> None:
        if self.order is None:
            self.whole = pa.Table.from_batches(self.texts).combine_chunks()
            row, self.known, self.base, self.model = (self.whole[c].to_numpy().copy() for c in ("row", "known", "base", "model"))
            self.order = np.argsort(row)
            self.sorted = row[self.order]

    def add(self, rows: bytes, known: bytes, sums: bytes) -> None:
        self._ready()
        at = self.order[np.searchsorted(self.sorted, _from_rising(rows))]  # packed rows are distinct
        base, model = np.frombuffer(_unpacked(sums), "<f8").reshape(2, -1)
        self.known[at] += _from_planes(known)
        self.base[at] += base
        self.model[at] += model

    def rows(self) -> pa.RecordBatch:
        self._ready()
        same = {c: self.whole[c].combine_chunks() for c in ("row", "doc_id", "held_out", "doc_tokens")}
        return _filled(_ROWS, len(self.order), same | {"known": self.known, "base": self.base, "model": self.model})


def _merged(sums: list[tuple]) -> tuple[int, dict[str, np.ndarray]]:
    """One entry per text with the sums over its tokens: their number and the columns."""
    row, known, base, model = (np.concatenate(x) for x in zip(*sums, strict=True))
    rows, place = np.unique(row, return_inverse=True)
    n = len(rows)
    return n, {
        "row": rows, "known": np.bincount(place, known, n).astype(np.int64), "base": np.bincount(place, base, n),
        "model": np.bincount(place, model, n),
    }


def _summed(sums: list[tuple], shards: int) -> pa.RecordBatch:
    """Sums of texts, packed into one row per shard by the text's number."""
    _, of = _merged(sums)
    shard = of["row"] % shards
    order = np.argsort(shard, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)[: len(order)])
    parts = [order[s:e] for s, e in zip(starts, np.append(starts[1:], len(order)), strict=True)]
    return _filled(_MIXED, len(parts), {
        "shard": shard[order[starts]].astype(np.int32), "kind": [SUMS] * len(parts), "a": [_rising(of["row"][p]) for p in parts],
        "b": [_planes(of["known"][p]) for p in parts], "c": [_packed(np.concatenate([of["base"][p], of["model"][p]]).astype("<f8").tobytes()) for p in parts],
    })


def query(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return scored(documents.withColumn("trained", ~F.col("held_out")))
