"""Conversation repair against a plain dynamic programme over (cost, audit) pairs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, extra string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def spaced(value):
    return " " if value is None else str(value)


def damage(rows):
    for conv, turn, role, text, *_ in rows:
        case = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if case == 0:
            yield conv, turn, role, text, 0
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        yield conv, turn, "user" if case == 4 else role, text, 2 if case == 3 else 1


def brute(messages):
    """Expected result rows: the least (cost, audit) over all edits, one message after another."""
    found = {}
    for conv, turn, role, text, copies in messages:
        found.setdefault(conv, []).extend([(turn, role, text)] * copies)
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()[:16]))
        seen, faults = set(), []
        for _, role, text in rows:
            marks = BLANK.findall(text)
            faults.append("blank" if not marks else "dup" if (role, text) in seen else "cut" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        initials = [r[1][:1] for r in rows]
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}
        # best[state] = (cost, audit, repaired) of a prefix; insertions are closed over at each place
        best = {"": (0, "", ())}

        def close(best):
            for _ in range(3):
                for state, (cost, audit, out) in list(best.items()):
                    to = follow[state]
                    new = (cost + 5, audit + "I", (*out, {"u": "user:", "a": "assistant:"}[to]))
                    if to not in best or new[:2] < best[to][:2]:
                        best[to] = new
            return best

        best = close(best)
        for (_, role, text), fault in zip(rows, faults, strict=True):
            after = {}

            def offer(state, value, after=after):
                if state not in after or value[:2] < after[state][:2]:
                    after[state] = value

            for state, (cost, audit, out) in best.items():
                offer(state, (cost + 2, audit + "D", out))
                if fault in ("blank", "dup"):
                    continue
                extra = 5 * (fault == "cut")
                if (state == "" and role[:1] == "s") or (role[:1] in ("u", "a") and role[:1] == follow[state]):
                    offer(role[:1], (cost + extra, audit + "K", (*out, f"{role}:{text}")))
                to = follow[state]
                offer(to, (cost + 1 + extra, audit + "R", (*out, {"u": "user:", "a": "assistant:"}[to] + text)))
            best = close(after)
        cost, audit, out = min(best[s] for s in ("", "a") if s in best)
        yield (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("dup"), faults.count("cut"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest(),
        )


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "so it is", " \t", "", "What? \n", "Yes.\u2028", "Ends. here", "é。", None, "long " * 400 + "."]
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(1, longest)):
            yield conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}{rng.choice('.!? ')}", "x"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [1, 2, 5, 7, 8, C.BLOCK])
def test_repair_is_the_least_audit_of_least_cost_at_any_block_size(spark, block):
    rows = list(random_rows(3, 60, 14))
    rows += rows[:7]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA)
    result = C.digests(*C.repair(C.damaged(df.withColumn("code", F.lit("clash"))), block))
    assert result.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    # an empty role fits nowhere, as in the brute-force programme, where it equals no state
    assert got(result) == sorted(brute(damage(rows)), key=repr)


def test_every_conversation_has_a_row_even_if_nothing_is_left(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", None)], SCHEMA)
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(C.digests(*C.repair(C.damaged(df)))) == [(gone, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert C.digests(*C.repair(C.damaged(df.limit(0)))).collect() == []


def test_repaired_messages_alternate_and_keep_whole_texts(spark):
    rows = list(random_rows(9, 40, 30))
    df = spark.createDataFrame(rows, SCHEMA)
    _, repaired = C.repair(C.as_given(df), 6)
    by_conversation = {}
    for r in sorted(repaired.collect(), key=lambda r: (repr(r.conv_id), r.place)):
        by_conversation.setdefault(r.conv_id, []).append(r)
    assert len(by_conversation) > 20
    given = {r[3] for r in rows}
    for messages in by_conversation.values():
        assert [m.place for m in messages] == list(range(len(messages)))
        assert re.fullmatch("(s?(ua)+)?", "".join(m.role[0] for m in messages))
        assert all(m.text in given or m.edit == "I" for m in messages)


def test_ranks_by_doubling_agree_with_one_letter_at_a_time():
    """The audit read off doubled pointers is the one a walk over the least optimal arc gives, for every start."""
    rng = np.random.default_rng(4)
    codes = [bytes((rng.integers(0, 4, n) + 4 * rng.integers(0, 4, n)).astype(np.uint8)) for n in (0, 1, 2, 33, 128)]
    solved = C.Solved(codes, np.tile(C.END, (len(codes), 1)), np.ones(len(codes), bool))
    audits, exits = solved.audits(np.tile(np.arange(4), len(codes)), np.repeat(np.arange(len(codes)), 4))
    for i, audit in enumerate(audits):
        at, state, walked = int(solved.base[i // 4]), i % 4, ""
        while True:
            arcs = solved._arcs(np.array([at]))[0, state]
            arcs[1] = solved.cost[at, C.NEXT[state]] + C.INSERT
            hits = [k for k in range(4) if arcs[k] == solved.cost[at, state]]
            if not hits:
                break
            k = hits[0]
            walked += "DIKR"[k]
            state = [state, C.NEXT[state], C.STEP[solved.number[at]][state], C.NEXT[state]][k]
            at += k != 1
        assert audit.decode() == walked and exits[i] == state
