"""Packing of tokenised examples into sequences under several limits at once.

Each example is a vector of demands: tokens, segments (always one) and loss-bearing tokens. Open sequences have a
vector of free room. The dot-product heuristic takes, among the waiting examples that fit in every dimension, the one
whose demand has the largest dot product with the room, both scaled by the limits. Waiting examples are kept in
classes of like demand, so a step looks at classes, not at examples. Where cutting is allowed, the best example is cut
to fill what no whole example fits.

Packing is local to a task: sequences never cross tasks, so there is no shuffle, and memory is bounded by ``window``
tokens waiting and one open sequence. Sequence numbers are ``task * 2**32 + count``; a task that is run again reads the
same rows and gives the same numbers.

Defined results: null texts count as empty (one closing token); blank and very long texts, ties and repeated rows are
packed as they come; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from veriloom.llm.common import whole_texts

LIMIT = 2048
MAX_SEGMENTS = 256
CLOSING_ID = 1
TOKENIZER = "word_bpe_49k.json"
WINDOW_TOKENS = 1 << 19
CACHE_WORDS = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit numbers, with the ids of each blank-separated word remembered.

    Exact, because this tokenizer drops white space and none of its rules reaches across it. Words of plain letters
    are encoded many at a time; their ends are found by the vocabulary's end-of-word mark.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", behavior="removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache_words = cache_words
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, bytes] = {"": b""}

    def _one(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        cache = self.cache
        plain: list[str] = []
        for word in words:
            stem = word.rstrip(".,;:!?")
            if not (stem.isalpha() and ord(max(stem)) < 0x250):
                cache[word] = self._one(word)
                continue
            plain.append(stem)
        lowered = [(s, s.lower()) for s in dict.fromkeys(plain) if s not in cache]
        new = list(dict.fromkeys(low for _, low in lowered))
        known: dict[str, bytes] = {}
        for at in range(0, len(new), 256):
            part = new[at : at + 256]
            ids = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                raw, begin = ids.tobytes(), 0
                for word, stop in zip(part, (stops * 4).tolist(), strict=True):
                    known[word] = raw[begin:stop]
                    begin = stop
            else:
                known.update((word, self._one(word)) for word in part)
        for stem, low in lowered:
            cache[stem] = known[low]
        for word in words:
            if word not in cache:
                stem = word.rstrip(".,;:!?")
                tail = word[len(stem) :]
                if tail not in cache:
                    cache[tail] = self._one(tail)
                cache[word] = cache[stem] + cache[tail]

    def __call__(self, text: str) -> bytes:
        if "<|" in text:  # special tokens may hold or touch anything
            return self._one(text)
        words = text.replace("\n", " ").split(" ")
        cache = self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            if len(cache) > self.cache_words:
                self.forget()
                cache = self.cache
            self._learn([w for w in dict.fromkeys(words) if w not in cache])
            return b"".join([cache[w] for w in words])


class Packer:
    """Streams examples into sequences; ``emit`` gets ``(key, start, length, sequence, offset)`` for each piece."""

    def __init__(self, limits: tuple[int, int, int], window: int, emit, cut: bool = True, first_sequence: int = 0):
        self.limits, self.window, self.emit, self.cut = limits, window, emit, cut
        self.classes: dict[tuple[int, int], deque] = {}
        self.waiting = 0
        self.sequence, self.unused = first_sequence, first_sequence + 1
        self._open()

    def _open(self) -> None:
        self.free = list(self.limits)
        self.offset = 0

    def _next(self) -> None:
        self.sequence, self.unused = self.unused, self.unused + 1
        self._open()

    def _class(self, tokens: int, loss: int) -> tuple[int, int]:
        step = max(1, self.limits[0] // 64)
        return -(-tokens // step), -(-loss // step)

    def add(self, key, tokens: int, loss: int, start: int = 0) -> None:
        """Queue an example; where cutting is allowed, full sequences are cut off a long one and emitted at once.

        The last ``loss`` tokens are those that bear loss, so what a piece has of them is known.
        """
        if not self.cut and (tokens > self.limits[0] or loss > self.limits[2]):
            raise ValueError(f"an example of {tokens} tokens, {loss} with loss, fits no sequence")
        while self.cut and (tokens > self.limits[0] or loss > self.limits[2]):
            size = min(self.limits[0], tokens - loss + self.limits[2])
            part = max(0, size - (tokens - loss))
            if size == self.limits[0]:
                self.emit(key, start, size, self.unused, 0)
                self.unused += 1
            else:
                self.classes.setdefault(self._class(size, part), deque()).append((key, start, size, part))
                self.waiting += size
            start, tokens, loss = start + size, tokens - size, loss - part
        if tokens:
            self.classes.setdefault(self._class(tokens, loss), deque()).append((key, start, tokens, loss))
            self.waiting += tokens
        while self.waiting > self.window:
            self._step()

    def _step(self) -> None:
        """Place one example into the open sequence, or close it when nothing more can go in."""
        room = [f / limit for f, limit in zip(self.free, self.limits, strict=True)]
        best, best_value = None, -1.0
        for kind, queue in self.classes.items():
            tokens, loss = queue[0][2], queue[0][3]
            if tokens <= self.free[0] and self.free[1] and loss <= self.free[2]:
                value = tokens / self.limits[0] * room[0] + room[1] / self.limits[1] + loss / self.limits[2] * room[2]
                if value > best_value:
                    best, best_value = kind, value
        if best is not None:
            item = self._take(best)
            self._place(item[0], item[1], item[2], item[3])
        elif self.cut and self.free[0] and self.free[1] and self.free[2] and self.waiting:
            kind = max(self.classes)
            key, start, tokens, loss = self._take(kind)
            size = min(tokens, self.free[0], tokens - loss + self.free[2])
            part = max(0, size - (tokens - loss))
            self._place(key, start, size, part)
            if tokens > size:
                self.classes.setdefault(self._class(tokens - size, loss - part), deque()).appendleft((key, start + size, tokens - size, loss - part))
                self.waiting += tokens - size
        else:
            self._next()
        if not self.free[0] or not self.free[1] or not self.free[2]:
            self._next()

    def _take(self, kind):
        queue = self.classes[kind]
        item = queue.popleft()
        if not queue:
            del self.classes[kind]
        self.waiting -= item[2]
        return item

    def _place(self, key, start: int, size: int, loss: int) -> None:
        self.emit(key, start, size, self.sequence, self.offset)
        self.offset += size
        for i, used in enumerate((size, 1, loss)):
            self.free[i] -= used

    def close(self) -> None:
        """Place all that waits. With cutting, the last tokens go into sequences of falling powers of two."""
        while self.waiting and (not self.cut or self.waiting + self.offset >= self.limits[0]):
            self._step()
        if self.offset:
            if not self.waiting:
                return
            self._next()
        while self.waiting:
            self.limits_whole, self.limits = self.limits, (1 << (self.waiting.bit_length() - 1), *self.limits[1:])
            self._open()
            before = self.sequence
            while self.waiting and self.sequence == before:
                self._step()
            self.limits = self.limits_whole


def pack(
    documents: DataFrame,
    tokenizer: str = TOKENIZER,
    limits: tuple[int, int, int] = (LIMIT, MAX_SEGMENTS, LIMIT),
    window: int = WINDOW_TOKENS,
) -> DataFrame:
    """Tokenise ``documents(doc_id, text)`` and pack them; one row per piece.

    A document's ids are those of its text and then ``CLOSING_ID``. Its loss-bearing tokens are all but the first, so
    the loss limit, equal to that of tokens by default, binds only where a caller gives a lower one.
    """
    path = public_tokenizers.path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        rows: list[tuple] = []

        def emit(key, start, size, sequence, offset):
            doc_id, ids = key
            rows.append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), len(ids) // 4, sequence, offset))

        packer = Packer(limits, window, emit, first_sequence=TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + closing
                tokens = len(ids) // 4
                packer.add((doc_id, ids), tokens, tokens - 1)
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows.clear()
        packer.close()
        encode.forget()
        yield _batch(rows)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


_FIELDS = pa.schema([(part.split()[0], pa.int64()) for part in SCHEMA.split(", ")])
_ENCODERS: dict[str, WordEncoder] = {}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FIELDS)


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, without the words of earlier tasks: workers outlive tasks, and so would memory."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    _ENCODERS[path].forget()
    return _ENCODERS[path]


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole_texts(spark)
    return pack(docs)
