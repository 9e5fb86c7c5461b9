"""Best-fit packing in bulk-synchronous rounds.

Items longer than half a sequence open sequences first, as no two share one. Then, round by round, items still waiting
and gaps still open are sorted together by range, over all tasks. A sweep from small to large keeps the items met so far;
a gap takes the largest of them, and goes on taking while the next one fits. Items that fit several gaps and gaps that
fit several items meet in the order of their ranks, so each item goes into one gap and no gap overflows. A task sweeps
its own range; what it cannot match is known by counts, one row per task, and items of a lower range are dealt by rank
to gaps of a higher one, as many a gap as surely fit. Then gaps are updated and the next round begins. A gap that
took nothing while items wait is smaller than all of them and is closed. Items larger than every gap left open new
sequences, as many as their lengths need at least, and the rest of them waits for those gaps.

Items and gaps are rows of three numbers; texts and ids stay where they are read. Round state is written to the shared
folder. Numbers of items come from their place in a written table, so a task run again gives the same ones.

Defined results of the query: a null text is empty (one closing token), as a blank one may be; texts are encoded whole;
repeated rows and null ids are packed as they come; ties go by number; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from veriloom.llm.common import stored, table

LIMIT = 1024
CLOSING_ID = 2
TOKENIZER = "byte_bpe_50k.json"
CACHE_WORDS = 250_000
LONGEST_WORD = 48
ROWS_PER_TASK = 50_000
PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteEncoder:
    """Ids of whole texts, with those of words remembered.

    Exact: this tokenizer never joins a word to the blank run before its own leading blank, so a text may be cut at each
    single blank, and around a line end between two words. Texts in which that blank lies inside a run of blanks, or that
    name a special token, are encoded whole. It also parts a word's letters from the marks behind them, so letters that
    have long been letters and plain marks go to its merges directly.
    """

    #: A single blank inside a run of blanks, by the widest notion of what is blank.
    RUN = re.compile("[{0}] (?:[{0}]|$)".format("\\s" + "".join(map(chr, (0x85, 0x180E, 0x200B, 0xFEFF)))))
    MARKS = string.punctuation
    LETTERS_TO = chr(0x180)

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = str.maketrans({c: spelt.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xA0, 0x180))})
        self.blank = spelt.pre_tokenize_str(" ")[0][0]
        self.line_end = self._ids("\n")
        self.cache_words = cache_words
        self.known_marks: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, spelt: str) -> bytes:
        return array("I", [t.id for t in self.merge(spelt)]).tobytes()

    def _marks(self, marks: str) -> bytes:
        found = self.known_marks.get(marks)
        if found is None:
            found = self._merged(marks)
            if len(marks) <= 2:  # at most about a thousand
                self.known_marks[marks] = found
        return found

    def _letters(self, word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) < self.LETTERS_TO)

    def _spelt(self, word: str) -> str:
        return word if word.isascii() else word.translate(self.spelling)

    def _word(self, word: str) -> bytes:
        """Ids of a word with a blank before it."""
        found = self.older.get(word)
        if found is None:
            stem = word.rstrip(self.MARKS)
            if len(word) > LONGEST_WORD or not self._letters(stem):
                return self._other(word)
            if len(stem) == len(word):
                found = self._merged(self.blank + self._spelt(word))
            else:
                found = (self.cache.get(stem) or self._word(stem)) + self._marks(word[len(stem) :])
        self.cache[word] = found
        return found

    def _other(self, word: str) -> bytes:
        lines = word.split("\n")
        if len(lines) > 1 and all(lines) and word.count("\n") == sum(map(str.isspace, word)):
            found = [self.cache.get(lines[0]) or self._word(lines[0])]
            for line in lines[1:]:
                stem = line.rstrip(self.MARKS)
                if self._letters(stem):
                    found.append(self._merged(self._spelt(stem)) + (self._marks(line[len(stem) :]) if len(stem) < len(line) else b""))
                else:
                    found.append(self._ids(line))
            return self.line_end.join(found)
        found = self._ids(" " + word)
        if len(word) <= LONGEST_WORD:
            self.cache[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        if "<|" in text or self.RUN.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        if len(self.cache) > self.cache_words:  # what is in use moves on from the older words when it is met
            self.cache, self.older = {}, self.cache
        body = list(map(self.cache.get, rest))
        if None in body:
            learn = self._word
            body = [ids or learn(word) for ids, word in zip(body, rest, strict=True)]
        return (self._ids(first) if first else b"") + b"".join(body)


def pieces(documents: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """Tokenised pieces of ``documents(doc_id, text)``, columns as in ``PIECES``; only longer documents are cut.

    All pieces of a cut document but the first have ``limit`` tokens. ``item`` numbers the pieces of the table.
    """
    path = public_tokenizers.path(tokenizer)
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteEncoder(path)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        item = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + closing
                tokens = len(ids) // 4
                start, length = 0, (tokens - 1) % limit + 1
                for piece in range(-(-tokens // limit)):
                    rows.append((item, doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    item, start, length = item + 1, start + length, limit
                if len(rows) >= 20_000:
                    yield batch_of()
                    rows.clear()
        yield batch_of()

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


#: ``kind`` 0 is an item of ``size``, 1 a gap of ``size``; ``id`` is the item's number or the number of the sequence's first item.
STATE = "kind int, id long, size long"
SWEPT = "kind int, id long, size long, sequence long, gap long, part int, place long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's part of a sweep over rows sorted by size, items before gaps.

    Gives each matched item its sequence and the gap it found; rows left over get their place among this task's left-over
    gaps (from the smallest) or items (from the largest). A gap that took items comes out as a gap of what is left, with
    ``part`` -1, as matched items do.
    """
    names = [c.split()[0] for c in SWEPT.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    part = TaskContext.get().partitionId()
    pending_ids: list[int] = []
    pending_sizes: list[int] = []
    rows: list[tuple] = []
    gaps = 0

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        d = batch.to_pydict()
        for kind, number, size in zip(d["kind"], d["id"], d["size"], strict=True):
            if not kind:
                pending_ids.append(number)
                pending_sizes.append(size)
            elif not pending_ids:
                rows.append((1, number, size, number, size, part, gaps))
                gaps += 1
            else:
                while pending_ids and pending_sizes[-1] <= size:
                    rows.append((0, pending_ids.pop(), taken := pending_sizes.pop(), number, size, -1, 0))
                    size -= taken
                rows.append((1, number, size, number, size, -1, 0))
        if len(rows) >= 20_000:
            yield batch_of()
            rows.clear()
    for place, (number, size) in enumerate(zip(reversed(pending_ids), reversed(pending_sizes), strict=True)):
        rows.append((0, number, size, -1, 0, part, place))
        if len(rows) >= 20_000:
            yield batch_of()
            rows.clear()
    if rows:
        yield batch_of()


def deal(ranges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which left-over items of lower ranges meet which left-over gaps of higher ones.

    ``ranges`` has ``(part, items, largest item, gaps, smallest gap)`` per task, rising. Gives runs ``(items' part, first
    place, gaps' part, first place, gaps, items a gap)``: the nearest lower range that has items left goes first.
    """
    waiting: list[list[int]] = []  # part, next place, items left, largest
    runs = []
    for part, items, largest, gaps, smallest in ranges:
        used = 0
        while used < gaps and waiting:
            low = waiting[-1]
            each = max(1, smallest // low[3])
            count = min(gaps - used, -(-low[2] // each))
            runs.append((low[0], low[1], part, used, count, each))
            taken = min(low[2], count * each)
            low[1], low[2], used = low[1] + taken, low[2] - taken, used + count
            if not low[2]:
                waiting.pop()
        if items:
            waiting.append([part, 0, items, largest])
    return runs


PLACED = "item long, sequence long, gap long, size long"


def pack(items: DataFrame, limit: int = LIMIT, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Place ``items(item long, size long)``, sizes from 1 to ``limit``; gives ``(item, sequence_id, offset)``.

    ``sequence_id`` is the number of a sequence's first item; items of a sequence lie one after another from 0.
    """
    spark = items.sparkSession
    full = items.filter(F.col("size") * 2 > limit)
    placed = [full.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    opened = full.filter(F.col("size") < limit).select(F.lit(1).alias("kind"), F.col("item").alias("id"), (F.lit(limit) - F.col("size")).alias("size"))
    waits = items.filter(F.col("size") * 2 <= limit).select(F.lit(0).alias("kind"), F.col("item").alias("id"), "size")
    state = stored(opened.unionByName(waits))
    while True:
        counts = {r.kind: (r.n, r.total, r.most) for r in state.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.max("size").alias("most")).collect()}
        if 0 not in counts:
            break
        rows = sum(c[0] for c in counts.values())
        most = counts.get(1, (0, 0, 0))[2]
        state = state.filter((F.col("kind") == 0) | (F.col("size") > 0))
        larger = state.filter((F.col("kind") == 0) & (F.col("size") > most))
        sums = larger.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()  # at most one row per length
        if sums:
            opening = _opening(larger, sums, limit)
            placed.append(opening.select(F.col("id").alias("item"), F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
            state = state.join(opening.select("id", F.lit(0).alias("kind")), ["id", "kind"], "left_anti").select("kind", "id", "size").unionByName(
                opening.select(F.lit(1).alias("kind"), "id", (F.lit(limit) - F.col("size")).alias("size"))
            )
        tasks = max(-(-rows // rows_per_task), min(spark.sparkContext.defaultParallelism, rows // 2000 + 1))
        ordered = state.withColumn("mixed", F.xxhash64("id")).repartitionByRange(tasks, "size", "kind", "mixed").sortWithinPartitions("size", "kind", "mixed")
        swept = stored(ordered.select("kind", "id", "size").mapInArrow(_sweep, SWEPT))
        ranges = {}
        for r in swept.filter("part >= 0").groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).collect():
            ranges.setdefault(r.part, {})[r.kind] = r
        runs = deal([
            (part, *((r[0].n, r[0].most) if 0 in r else (0, 0)), *((r[1].n, r[1].least) if 1 in r else (0, 0))) for part, r in sorted(ranges.items())
        ])
        state, found = _dealt(spark, swept, runs)
        placed.append(found.select("item", F.col("sequence").alias("sequence_id"), (F.lit(limit) - F.col("gap")).alias("offset")))
    out = placed[0]
    for df in placed[1:]:
        out = out.unionByName(df)
    return out


def _opening(larger: DataFrame, sums: list, limit: int) -> DataFrame:
    """The largest of the items that no gap takes, as many as all of them need sequences at least."""
    needed = -(-sum(r.size * r.n for r in sums) // limit)
    whole, border, rest = 0, None, needed
    for r in sums:
        if rest <= 0:
            break
        border, whole, rest = r.size, rest, rest - r.n
    if rest >= 0:  # all items of the last length open one
        return stored(larger.filter(F.col("size") >= border))
    # ``whole`` of the last length do: those of the lowest hashes, found as a threshold from a histogram.
    mixed = F.xxhash64("id")
    at = larger.filter(F.col("size") == border).select("id", "size", mixed.alias("mixed"))
    low, high = -(1 << 63), (1 << 63) - 1
    while True:
        width = (high - low) // 256 + 1
        slot = F.floor((F.col("mixed").cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)")) / F.lit(str(width)).cast("decimal(38,0)")).cast("int")
        counted = dict(at.filter(F.col("mixed").between(low, high)).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect())
        before = 0
        for number in sorted(counted):
            if before + counted[number] >= whole:
                break
            before += counted[number]
        whole -= before
        low, high = low + number * width, min(high, low + (number + 1) * width - 1)
        if counted[number] == whole or low == high:
            break
    return stored(larger.filter((F.col("size") > border) | ((F.col("size") == border) & (mixed <= high))))


def _dealt(spark, swept: DataFrame, runs: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """State after a round, and all items placed in it with the gap that each found."""
    matched = swept.filter("part < 0 AND kind = 0").select(F.col("id").alias("item"), "sequence", "gap", "size")
    updated = swept.filter("part < 0 AND kind = 1").select("kind", "id", "size")
    left_items = swept.filter("part >= 0 AND kind = 0")
    if not runs:
        return stored(updated.filter("size > 0").unionByName(left_items.select("kind", "id", "size"))), matched
    # One narrow row per run of two tasks: at most twice as many as tasks.
    table_of_runs = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(runs)], "run int, low int, first long, high int, begin long, n long, each long"))
    items = left_items.join(table_of_runs, (F.col("part") == F.col("low")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n") * F.col("each")), "left")
    # Two runs may touch in a range of which the first takes fewer than n * each items: places of the later run are beyond.
    gaps = swept.filter("part >= 0 AND kind = 1").join(
        table_of_runs, (F.col("part") == F.col("high")) & (F.col("place") >= F.col("begin")) & (F.col("place") < F.col("begin") + F.col("n"))
    ).select("run", (F.col("place") - F.col("begin")).alias("slot"), F.col("id").alias("sequence"), F.col("size").alias("gap"))
    asked = items.filter("run IS NOT NULL").select(
        "run", F.floor((F.col("place") - F.col("first")) / F.col("each")).cast("long").alias("slot"), F.col("id").alias("item"), "size", ((F.col("place") - F.col("first")) % F.col("each")).alias("turn")
    )
    # A gap takes at most as many items as there are tokens in a sequence.
    taken = asked.groupBy("run", "slot").agg(F.array_sort(F.collect_list(F.struct("turn", "item", "size"))).alias("items"))
    met = stored(gaps.join(taken, ["run", "slot"]))
    used = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + x["size"])
    one = met.select("sequence", "gap", "items", F.posexplode("items").alias("at", "one"))
    found = one.select(
        F.col("one.item").alias("item"), "sequence", (F.col("gap") - used(F.slice("items", F.lit(1), F.col("at")))).alias("gap"), F.col("one.size").alias("size")
    )
    after = met.select(F.lit(1).alias("kind"), F.col("sequence").alias("id"), (F.col("gap") - used(F.col("items"))).alias("size"))
    waiting = items.filter("run IS NULL").select("kind", "id", "size")
    state = updated.unionByName(after).filter("size > 0").unionByName(waiting)
    return stored(state), matched.unionByName(found)


def best_fit(documents: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """Pieces of ``documents(doc_id, text)`` with their sequence and place in it."""
    cut = stored(pieces(documents, tokenizer, limit))
    places = pack(cut.select("item", F.col("length").alias("size")), limit)
    return cut.join(places, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents").select("doc_id", "text"))
