"""Conversation structure repair: the cheapest edits that make roles alternate, and among those the least audit.

A conversation is a path through a graph: a node is a place between messages and the state reached (nothing yet, after
system, after user, after assistant); an arc keeps, re-roles, deletes or inserts a message. A cost DP from the end leaves
the optimal arcs. Their nodes are ranked by audits of one letter, then of two, four and so on edits (prefix doubling: the
rank of a pair of ranks, along pointers that double too) until every path has ended; each node then takes the arc of the
least letter and target rank, and the audit is read off along the doubled pointers of those arcs.

Conversations of any length: messages are sorted by range over all tasks and travel as ``codes`` (one byte: role and
fault) in blocks of at most ``BLOCK`` messages. A block of a longer conversation is first a 4 x 4 matrix of cheapest costs
(state before, state after); matrices are chained, one row per block, and each block is then solved for the costs that
follow it. Texts move once, when the repaired messages are made; deciding needs 16 bytes of their SHA-256. The one step
that is serial by its definition is the SHA-256 over a conversation's whole repaired text, which reads a sorted stream.

Defined results: a null role, text or part of the damage key is one space, so a null text is blank and a null role fits
nowhere; so does an empty role. Null ids form one conversation, null turns come first and count for no gap. Messages of
equal turn are ordered by role and text hash, repeated rows are adjacent and all but the first are duplicates. Texts are
used whole. An empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import stored, table

BLOCK = 8192
START, SYSTEM, USER, ASSISTANT = range(4)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
FAR = 1 << 50
#: State after a message whose role initial has this number (s, u, a, other), by state before; -1: not allowed.
STEP = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: The state that a re-roled or inserted message leads to.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Cheapest way to end from each state: nothing, "ua", "a", nothing.
END = np.array([0, 2 * INSERT, INSERT, 0])
LETTERS = b"\0DIKR"
BLANKS = "\\x20\\x09-\\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: planted damage by the id's checksum; dropped messages have no copies."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))), F.lit(20))
    text = F.when(case == 1, F.lit("")).when(case == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(case == 4, F.lit("user")).otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.when(case == 0, F.lit(0)).when(case == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def as_given(conversations: DataFrame) -> DataFrame:
    """The same columns without damage."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"), F.lit(1).cast("long").alias("copies"))


def text_key() -> Column:
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("h")


ORDER = ["conv_id", "turn", "role", "h"]


def coded(messages: DataFrame) -> DataFrame:
    """Distinct messages with their copies and ``first`` code byte; later copies of a message are duplicates.

    Whether a role and text came earlier is a minimum per role and text, joined back: no group meets in one task.
    """
    last = F.regexp_extract("text", f"([^{BLANKS}])[{BLANKS}]*\\z", 1)
    number = F.coalesce(
        *[F.when(F.substring("role", 1, 1) == r, F.lit(i)) for i, r in enumerate("sua")], F.lit(3)
    )
    # A dropped message has no copies; it stays, without turn and text, so that its conversation is known.
    here = F.col("copies") > 0
    light = (
        messages.select(
            "conv_id", F.when(here, F.col("turn")).alias("turn"), F.when(here, F.col("role")).otherwise("").alias("role"),
            F.when(here, text_key()).alias("h"), "copies", F.when(here, number).otherwise(3).alias("number"),
            F.when(last == "", BLANK).when(last.isin(".", "!", "?"), 0).otherwise(TRUNCATED).alias("fault"),
        )
        .groupBy("conv_id", "turn", "role", "h", "number", F.when(here, F.col("fault")).otherwise(0).alias("fault"))
        .agg(F.sum("copies").alias("copies"))
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    earliest = (
        light.filter("copies > 0 AND fault <> 1").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("k"))
        .agg(F.min(place).alias("earliest"))
    )
    joined = light.join(earliest, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k")), "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("earliest") < place), DUPLICATE).otherwise(F.col("fault"))
    return joined.select("conv_id", "turn", "role", "h", "copies", (F.col("number") + 4 * fault).cast("int").alias("code"))


#: Messages solved at once in one task.
LAYERS = 1 << 17
BLOCKS = (
    "conv_id long, part long, turn long, role string, h binary, codes binary, first_turn long, last_turn long, turns long"
)


def _blocks(limit: int):
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        number, conv, codes, head, first, last, turns = -1, None, None, None, None, None, 0

        def close() -> None:
            rows.append([conv, (part << 40) + number, *head, bytes(codes), first, last, turns])

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        part = 0
        for batch in batches:
            d = batch.to_pydict()
            for conv_id, turn, role, h, copies, code, part in zip(*(d[c] for c in (*ORDER, "copies", "code", "part")), strict=True):
                waiting, letter = copies, code
                while True:
                    if codes is None or conv_id != conv or len(codes) >= limit:
                        if codes is not None:
                            close()
                        number, conv, codes, head, first, last, turns = number + 1, conv_id, bytearray(), (turn, role, h), None, None, 0
                    if waiting and turn is not None:
                        if first is None:
                            first = turn
                        if turn != last:
                            turns, last = turns + 1, turn
                    if not waiting:
                        break
                    codes.append(letter)
                    if letter >> 2 != BLANK:
                        letter = (letter & 3) + 4 * DUPLICATE
                    more = min(waiting - 1, limit - len(codes))
                    codes.extend(bytes([letter]) * more)
                    waiting -= 1 + more
                    if not waiting:
                        break
                if len(rows) >= 2000:
                    yield batch_of()
                    rows.clear()
        if codes is not None:
            close()
            yield batch_of()

    return run


def blocks(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """Codes of consecutive messages, at most ``block`` a row, in the order of ``part`` inside a conversation.

    Sorted by range, so a conversation of any size is dealt over tasks; ``turn, role, h`` are of the block's first message.
    """
    ordered = coded(messages).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id().cast("long"))
    return stored(ordered.mapInArrow(_blocks(block), BLOCKS))


class Solved:
    """Optimal costs of a batch of blocks, and the least audit of each from a given state."""

    def __init__(self, codes: list[bytes], ends: np.ndarray, last: np.ndarray):
        """``ends``: cheapest costs after each block, ``blocks x 4``; ``last``: where the conversation ends with the block."""
        self.lengths = np.array([len(c) for c in codes], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        layers = int(self.base[-1])
        code = np.zeros(layers, np.int64)
        inside = np.ones(layers, bool)
        inside[self.base[1:] - 1] = False
        code[inside] = np.frombuffer(b"".join(codes), np.uint8)
        self.number, self.fault = code & 3, code >> 2
        self.inside, self.last = inside, last
        self.cost = np.full((layers, 4), FAR, np.int64)
        self.cost[self.base[1:] - 1] = ends
        order = np.argsort(-self.lengths, kind="stable")
        falling = -self.lengths[order]
        for step in range(1, int(self.lengths.max(initial=0)) + 1):
            some = order[: np.searchsorted(falling, -step, side="right")]
            at = self.base[some + 1] - 1 - step
            best = self._arcs(at)[:, :, (0, 2, 3)].min(axis=2)
            user = np.minimum(best[:, USER], best[:, ASSISTANT] + INSERT)
            best[:, ASSISTANT] = np.minimum(best[:, ASSISTANT], best[:, USER] + INSERT)
            best[:, USER] = user
            best[:, START] = np.minimum(best[:, START], user + INSERT)
            best[:, SYSTEM] = np.minimum(best[:, SYSTEM], user + INSERT)
            self.cost[at] = best

    def _arcs(self, at: np.ndarray) -> np.ndarray:
        """Cost to the end through each arc (delete, insert, keep, re-role) of the nodes of some layers."""
        after = self.cost[np.minimum(at + 1, len(self.cost) - 1)]
        inside = self.inside[at][:, None]
        usable = inside & (self.fault[at] != BLANK)[:, None] & (self.fault[at] != DUPLICATE)[:, None]
        extra = (self.fault[at] == TRUNCATED)[:, None] * CUT_OFF
        kept = STEP[self.number[at]]
        out = np.full((len(at), 4, 4), FAR, np.int64)
        out[:, :, 0] = np.where(inside, after + DELETE, FAR)
        out[:, :, 2] = np.where(usable & (kept >= 0), np.take_along_axis(after, np.maximum(kept, 0), 1) + KEEP + extra, FAR)
        out[:, :, 3] = np.where(usable, after[:, NEXT] + REROLE + extra, FAR)
        return out

    def start_costs(self) -> np.ndarray:
        return self.cost[self.base[:-1]]

    def _doubled(self, pointer: np.ndarray) -> Iterator[np.ndarray]:
        """Pointers over 1, 2, 4 ... edits, until all paths have ended."""
        while True:
            yield pointer
            if (pointer[pointer] == pointer).all():
                return
            pointer = pointer[pointer]

    def audits(self, states: np.ndarray, of: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The least audit of block ``of[i]`` from state ``states[i]``, and the state after it."""
        layers = np.arange(len(self.cost))
        arcs = self._arcs(layers)
        closing = np.ones(len(layers), bool)
        closing[self.base[1:] - 1] = self.last  # insertions behind a block belong to the next one, if there is one
        arcs[:, :, 1] = np.where(closing[:, None], self.cost[:, NEXT] + INSERT, FAR)
        optimal = (arcs == self.cost[:, :, None]) & (self.cost < FAR)[:, :, None]
        node = 4 * layers[:, None] + np.arange(4)
        kept = np.maximum(STEP[self.number], 0)
        target = np.stack([node + 4, 4 * layers[:, None] + NEXT, 4 * (layers + 1)[:, None] + kept, 4 * (layers + 1)[:, None] + NEXT], 2)
        optimal, target, node = optimal.reshape(-1, 4), target.reshape(-1, 4), node.reshape(-1)
        target = np.where(optimal, target, node[:, None])

        # Ranks of the least audits of 1, 2, 4 ... letters; a path that has ended ranks before all others.
        rank = np.where(optimal.any(axis=1), optimal.argmax(axis=1) + 1, 0)
        pointer = target[np.arange(len(node)), optimal.argmax(axis=1)]
        for doubled in self._doubled(pointer):
            rank = np.unique(rank * (rank.max() + 1) + rank[doubled], return_inverse=True)[1]
        # Each node takes its arc of the least letter and then of the least audit behind it.
        value = np.where(optimal, np.arange(1, 5) * (rank.max() + 1) + rank[target], np.iinfo(np.int64).max)
        taken = value.argmin(axis=1)
        letter = np.where(optimal.any(axis=1), taken + 1, 0)
        chosen = list(self._doubled(target[np.arange(len(node)), taken]))
        length, steps = (letter > 0).astype(np.int64), []
        for doubled in chosen:
            steps.append(doubled)
            length = length + length[doubled] * (doubled != node)

        begin = 4 * self.base[of] + states
        sizes = length[begin]
        path = np.repeat(begin, sizes)
        place = np.arange(len(path)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for bit, doubled in enumerate(steps):
            here = (place >> bit) & 1 == 1
            path[here] = doubled[path[here]]
        written = np.frombuffer(LETTERS, np.uint8)[letter[path]].tobytes()
        cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        exits = steps[-1][steps[-1][begin]] if steps else begin
        return [written[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], exits % 4


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
PLANS = f"conv_id string, part long, turn string, role string, h binary, state int, first boolean, {FACTS}, cost long, audit string"
_ILLEGAL = ~np.array([[False, True, False, False], [False, False, True, False], [False, True, False, False], [False] * 4])


def _facts(codes: np.ndarray) -> tuple[int, int, int, int]:
    number, fault = codes & 3, codes >> 2
    return int((fault == BLANK).sum()), int((fault == DUPLICATE).sum()), int((fault == TRUNCATED).sum()), int(_ILLEGAL[number[:-1], number[1:]].sum())


def _portions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with at most about ``LAYERS`` messages together, however long the blocks are."""
    for frame in frames:
        group = (frame["codes"].str.len() + 1).cumsum() // LAYERS
        for _, portion in frame.groupby(group.to_numpy(), sort=True):
            yield portion.reset_index(drop=True)


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations of one block."""
    for frame in _portions(frames):
        solved = Solved(frame["codes"].tolist(), np.tile(END, (len(frame), 1)), np.ones(len(frame), bool))
        audits, _ = solved.audits(np.zeros(len(frame), np.int64), np.arange(len(frame)))
        facts = [_facts(np.frombuffer(c, np.uint8)) for c in frame["codes"]]
        out = frame[["conv_id", "part", "turn", "role", "h"]].copy()
        out["state"], out["first"] = START, True
        out["gaps"] = [int(b) - int(a) + 1 - t if t else 0 for a, b, t in zip(frame["first_turn"], frame["last_turn"], frame["turns"], strict=True)]
        for name, values in zip(("blank", "duplicate", "truncated", "illegal"), zip(*facts, strict=True), strict=True):
            out[name] = values
        out["cost"] = solved.start_costs()[:, START]
        out["audit"] = [a.decode() for a in audits]
        yield out


def _matrix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cheapest cost of each block from each state before to each state after it."""
    for frame in _portions(frames):
        units = np.where(np.eye(4, dtype=bool), 0, FAR)
        columns = [Solved(frame["codes"].tolist(), np.tile(u, (len(frame), 1)), np.zeros(len(frame), bool)).start_costs() for u in units]
        out = frame.drop(columns=["codes"])
        out["costs"] = list(np.minimum(np.stack(columns, axis=2), FAR).reshape(len(frame), 16))
        out["numbers"] = [[int(c[0]) & 3, int(c[-1]) & 3] if c else [-1, -1] for c in frame["codes"]]
        out["counts"] = [list(_facts(np.frombuffer(c, np.uint8))) for c in frame["codes"]]
        yield out


def _chain(group: pd.DataFrame) -> pd.DataFrame:
    """Costs after each block of one conversation, from the last block back, and the conversation's totals."""
    group = group.sort_values("part").reset_index(drop=True)
    ends = [END]
    for costs in group["costs"][::-1]:
        ends.append(np.minimum((np.array(costs).reshape(4, 4) + ends[-1][None, :]).min(axis=1), FAR))
    totals = np.array(group["counts"].tolist(), np.int64).sum(axis=0)
    turns, illegal, before, number = 0, 0, None, -1
    seen = [(int(a), int(b), int(t)) for a, b, t in zip(group["first_turn"], group["last_turn"], group["turns"], strict=True) if t]
    for a, b, t in seen:
        turns, before = turns + t - (a == before), b
    for first, last in group["numbers"]:
        if first >= 0:
            illegal += bool(number >= 0 and _ILLEGAL[number, first])
            number = last
    out = group[["conv_id", "part"]].copy()
    out["ends"] = [e.tolist() for e in ends[-2::-1]]
    out["last"] = [False] * (len(group) - 1) + [True]
    out["first"] = [True] + [False] * (len(group) - 1)
    out["gaps"] = seen[-1][1] - seen[0][0] + 1 - turns if seen else 0
    for name, value in zip(("blank", "duplicate", "truncated", "illegal"), totals, strict=True):
        out[name] = int(value)
    out["illegal"] += illegal
    out["cost"] = int(ends[-1][START])
    return out


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each block's least audit and state after it, for each state before it."""
    for frame in _portions(frames):
        solved = Solved(frame["codes"].tolist(), np.array(frame["ends"].tolist(), np.int64), frame["last"].to_numpy(bool))
        audits, exits = solved.audits(np.tile(np.arange(4), len(frame)), np.repeat(np.arange(len(frame)), 4))
        out = frame[["conv_id", "part"]].copy()
        out["audits"] = [[a.decode() for a in audits[i : i + 4]] for i in range(0, len(audits), 4)]
        out["exits"] = list(exits.reshape(-1, 4))
        yield out


def _states(group: pd.DataFrame) -> pd.DataFrame:
    """The state before each block of one conversation."""
    group = group.sort_values("part").reset_index(drop=True)
    states = [START]
    for exits in group["exits"][:-1]:
        states.append(int(exits[states[-1]]))
    return pd.DataFrame({"conv_id": group["conv_id"], "part": group["part"], "state": states})


def plans(packed: DataFrame) -> DataFrame:
    """Per block: its audit, the state before it, and on the conversation's ``first`` block the totals."""
    # pandas has no whole numbers beside nulls: what may be null goes through it as text.
    named = ("conv_id", "turn", "first_turn", "last_turn")
    packed = packed.withColumns({c: F.col(c).cast("string") for c in named})
    long = packed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("conv_id", "c")
    marked = packed.join(long, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    whole = marked.filter("n = 1").drop("n").mapInPandas(_whole, PLANS)
    several = stored(marked.filter("n > 1").drop("n"))
    matrices = several.drop("turn", "role", "h").mapInPandas(
        _matrix, "conv_id string, part long, first_turn string, last_turn string, turns long, costs array<long>, numbers array<int>, counts array<long>"
    )
    chained = stored(
        matrices.groupBy("conv_id").applyInPandas(_chain, f"conv_id string, part long, ends array<long>, last boolean, first boolean, {FACTS}, cost long")
    )
    renamed = chained.withColumnsRenamed({"conv_id": "c", "part": "p"})
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    known = several.join(renamed, same).drop("c", "p")
    segments = stored(known.select("conv_id", "part", "codes", "ends", "last").mapInPandas(_segments, "conv_id string, part long, audits array<string>, exits array<long>"))
    states = segments.select("conv_id", "part", "exits").groupBy("conv_id").applyInPandas(_states, "conv_id string, part long, state int")
    chosen = segments.join(states.withColumnsRenamed({"conv_id": "c", "part": "p"}), same).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), "state", F.element_at("audits", F.col("state") + 1).alias("audit")
    )
    chained_blocks = known.join(chosen, same).select(*[c.split()[0] for c in PLANS.split(", ")])
    return whole.unionByName(chained_blocks).withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})


REPAIRED = "conv_id long, place long, role string, text string, edit string"


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply audits to the sorted stream of messages and, each before its first message, blocks of audits."""
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    rows: list[tuple] = []
    conv, letters, state, place = None, deque(), START, 0

    def inserted() -> None:
        nonlocal state, place
        letters.popleft()
        state = int(NEXT[state])
        rows.append((conv, place, "user" if state == USER else "assistant", "", "I"))
        place += 1

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    started = False
    for batch in batches:
        d = batch.to_pydict()
        for conv_id, kind, role, text, copies, audit in zip(*(d[c] for c in ("conv_id", "kind", "role", "text", "copies", "audit")), strict=True):
            if not started or conv_id != conv:
                while letters:
                    inserted()
                conv, state, place, started = conv_id, START, 0, True
            if kind == 0:
                letters.extend(audit)
                continue
            for _ in range(copies):
                while letters[0] == "I":
                    inserted()
                edit = letters.popleft()
                if edit == "D":
                    continue
                if edit == "R":
                    state = int(NEXT[state])
                    rows.append((conv, place, "user" if state == USER else "assistant", text, edit))
                else:
                    state = int(STEP["sua".find(role[0])][state])
                    rows.append((conv, place, role, text, edit))
                place += 1
        if len(rows) >= 1000:
            yield batch_of()
            rows.clear()
    while letters:
        inserted()
    if rows:
        yield batch_of()


def rewritten(messages: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired messages ``(conv_id, place, role, text, edit)``, each conversation in order inside one partition."""
    texts = messages.filter("copies > 0").select(
        "conv_id", "turn", "role", text_key(), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("part"), "text", "copies", F.lit(None).cast("string").alias("audit")
    )
    audits = planned.select(
        "conv_id", "turn", "role", "h", F.lit(0).alias("kind"), "part", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "audit"
    )
    stream = texts.unionByName(audits).repartition("conv_id").sortWithinPartitions(*ORDER, "kind", "part")
    return stream.select("conv_id", "kind", "role", "text", "copies", "audit").mapInArrow(_rewrite, REPAIRED)


def repair(messages: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(planned, repaired)`` of ``messages`` in the form of ``as_given``: audit blocks with totals, and repaired messages."""
    planned = stored(plans(blocks(messages, block)))
    return planned, rewritten(messages, planned)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ``role:text`` lines of each conversation, read in order."""
    conv, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        d = batch.to_pydict()
        for conv_id, place, role, text in zip(d["conv_id"], d["place"], d["role"], d["text"], strict=True):
            if not place:
                if digest:
                    done.append((conv, digest.hexdigest()))
                conv, digest = conv_id, hashlib.sha256()
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([h for _, h in done])], ["c", "repaired_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], ["c", "repaired_sha256"])


def digests(planned: DataFrame, repaired: DataFrame) -> DataFrame:
    """One row per conversation: totals, the whole audit and the hash of the repaired conversation."""
    hashes = repaired.select("conv_id", "place", "role", "text").mapInArrow(_hashes, "c long, repaired_sha256 string")
    totals = [F.max(F.when(F.col("first"), F.col(c.split()[0]))).alias(c.split()[0]) for c in f"{FACTS}, cost long".split(", ")]
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda b: b["audit"]), "")
    whole = planned.groupBy("conv_id").agg(*totals, ordered.alias("audit"))
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.join(hashes, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *[c.split()[0] for c in FACTS.split(", ")], "cost", "audit", F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    messages = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return digests(*repair(messages))
