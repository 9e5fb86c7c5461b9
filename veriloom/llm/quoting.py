"""Conversations without quotes: quoted passages are linked to the messages they come from.

A line's quote level is its number of leading ``>`` marks. A passage is a run of quoted lines of one level, up to a blank
one; quoted lines and passages are normalised (lower case, white space, line breaks too) and hashed, and joined to the
hashed lines, paragraphs and whole own texts of all messages: the earliest message of the same conversation that says it,
else, for passages and lines of at least ``PASSAGE_CHARS`` characters only, the earliest of any conversation. So a common
short line never links two conversations, and a passage with other line breaks still finds its paragraph. Each hit counts
by its lines, and the message with the most at a level is the one quoted there; level one gives the parent. A line that announces a
quote goes with it. What is left is the message's own text.

A reply's depth is its number of steps to the message that starts its thread, found by doubling pointers; a message's
position is its place in its thread, counted from zero in the order of depth, conversation and turn. Lines said by very many messages are reduced to their earliest sayer before any
join, so no group of equal lines is paired.

Defined results: null texts are blank messages; nested quotes without a known origin count as quoted lines without a link;
a message never links to itself or to a later one; short lines and passages link within their conversation only; null conversations or turns link to nothing and have no position;
repeated rows give a row each and share a position; ties go to the earliest message; lines of any length link; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import stored, table
from veriloom.operators.skew import ranked

MARKS = re.compile(r"^\s*((?:>\s?)+)(.*)$", re.S)
ANNOUNCES = re.compile(r"^\s*(?:on\b.+\bwrote|am\b.+\bschrieb.*|le\b.+\ba écrit|el\b.+\bescribió)\s*:\s*$", re.I)
SLICE_ROWS = 20_000
PASSAGE_CHARS = 40


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The own text of a message, and its quoted lines as ``(level, normalised line)``, blank ones too."""
    own: list[str] = []
    quoted: list[tuple[int, str]] = []
    for line in (text or "").splitlines():
        found = MARKS.match(line)
        if not found:
            own.append(line)
            if quoted and quoted[-1][1]:
                quoted.append((quoted[-1][0], ""))  # own text ends a passage
            continue
        while own and not own[-1].strip():
            own.pop()
        if own and ANNOUNCES.match(own[-1]):
            own.pop()
        quoted.append((found.group(1).count(">"), normalised(found.group(2))))
    return "\n".join(own).strip(), quoted


def normalised(line: str) -> str:
    return " ".join(line.lower().split())


def passages(lines: list[str]) -> Iterator[list[str]]:
    """The runs of lines between blank ones."""
    run: list[str] = []
    for line in [*lines, ""]:
        if line:
            run.append(line)
        elif run:
            yield run
            run = []


def said(body: str) -> set[str]:
    """What a message says, normalised: its lines, its paragraphs and the whole."""
    lines = [normalised(line) for line in body.splitlines()]
    return {*lines, *(" ".join(p) for p in passages(lines)), normalised(body)} - {""}


def asked(quoted: list[tuple[int, str]]) -> dict[tuple[int, str], int]:
    """What a message quotes: ``(level, line or passage)`` with its number of lines."""
    out: dict[tuple[int, str], int] = {}
    for level in {q for q, _ in quoted}:
        # a line of another level ends a passage too
        runs = list(passages([line if q == level else "" for q, line in quoted]))
        for run in [*runs, *([sum(runs, [])] if len(runs) > 1 else [])]:
            out[level, " ".join(run)] = max(len(run), out.get((level, " ".join(run)), 0))
            for line in run:
                out.setdefault((level, line), 1)
    return out


def _hash(passage: str) -> int:
    h = xxhash.xxh64_intdigest(passage.encode("utf-8", "replace"), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def _parsed(messages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse(t) for t in batch]
            wanted = [asked(q) for _, q in found]
            yield pd.DataFrame({
                "body": [b for b, _ in found], "quoted_lines": [sum(bool(line) for _, line in q) for _, q in found],
                "said": [[_hash(x) for x in said(b)] for b, _ in found], "levels": [[level for level, _ in w] for w in wanted],
                "keys": [[_hash(x) for _, x in w] for w in wanted], "sizes": [list(w.values()) for w in wanted],
                "wide": [[len(x) >= PASSAGE_CHARS for _, x in w] for w in wanted],
            })

    udf = F.pandas_udf(run, "body string, quoted_lines long, said array<long>, levels array<int>, keys array<long>, sizes array<int>, wide array<boolean>")
    return messages.withColumn("_p", udf(F.col("text"))).select("conv_id", "turn", "role", "_p.*")


def linked(messages: DataFrame) -> DataFrame:
    """One row per message: body, parent, number of quoted lines and of levels linked, thread, depth and position."""
    parsed = stored(_parsed(messages.select("conv_id", "turn", "role", F.col("text"))))
    named = parsed.filter("conv_id is not null and turn is not null")
    quotes = named.filter("size(levels) > 0").select("conv_id", "turn", F.explode(F.arrays_zip("levels", "keys", "sizes", "wide")).alias("q"))
    quotes = stored(quotes.select("conv_id", "turn", F.col("q.levels").alias("level"), F.col("q.keys").alias("h"), F.col("q.sizes").alias("size"), F.col("q.wide").alias("wide")).distinct())
    said = named.select("conv_id", "turn", F.explode("said").alias("h"))
    # only what somebody quotes, and of that the earliest sayer per conversation
    wanted = quotes.select("h").distinct()
    here = stored(said.join(wanted, "h", "left_semi").groupBy("h", "conv_id").agg(F.min("turn").alias("from_turn")))
    anywhere = here.join(quotes.filter("wide").select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min(F.struct(F.col("conv_id").alias("c"), F.col("from_turn").alias("t"))).alias("first"))
    found = quotes.join(here, ["h", "conv_id"], "left").join(anywhere, "h", "left")
    same = F.col("from_turn") < F.col("turn")
    origin = F.when(same, F.struct(F.col("conv_id").alias("c"), F.col("from_turn").alias("t"))).when(
        F.col("wide") & (F.col("first.c") < F.col("conv_id")), F.col("first")
    )
    votes = found.withColumn("origin", origin).filter("origin is not null").groupBy("conv_id", "turn", "level", "origin").agg(F.sum("size").alias("n"))
    best = F.max_by("origin", F.struct("n", (-F.col("origin.c")).alias("c"), (-F.col("origin.t")).alias("t"))).alias("origin")
    levels = stored(votes.groupBy("conv_id", "turn", "level").agg(best))
    parents = levels.groupBy("conv_id", "turn").agg(F.min_by("origin", "level").alias("parent"), F.count(F.lit(1)).cast("long").alias("n_linked"))
    # double the pointers: after each round a message points twice as far up
    up = stored(parents.select("conv_id", "turn", F.col("parent.c").alias("c"), F.col("parent.t").alias("t"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = up.select(F.col("conv_id").alias("ac"), F.col("turn").alias("at"), F.col("c").alias("uc"), F.col("t").alias("ut"), F.col("depth").alias("more"))
        longer = up.join(above, (up["c"] == above["ac"]) & (up["t"] == above["at"]), "left")
        longer = stored(longer.select("conv_id", "turn", F.coalesce("uc", "c").alias("c"), F.coalesce("ut", "t").alias("t"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved")))
        if longer.filter("moved").isEmpty():
            break
        up = longer.drop("moved")
    threads = up.join(parents, ["conv_id", "turn"])
    out = parsed.join(threads, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", F.col("parent.c").alias("parent_conv"), F.col("parent.t").alias("parent_turn"),
        "quoted_lines", F.coalesce("n_linked", F.lit(0)).alias("levels_linked"),
        F.coalesce("c", "conv_id").alias("thread_conv"), F.coalesce("t", F.when(F.col("c").isNull(), F.col("turn"))).alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    thread = ["thread_conv", "thread_turn"]
    places = out.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "depth", *thread).distinct()
    places = stored(places.withColumn("_id", F.xxhash64("conv_id", "turn")))
    places = ranked(places, thread, ["depth", "conv_id", "turn"], "_id", rank="position", slice_rows=SLICE_ROWS)
    return out.join(places.select("conv_id", "turn", (F.col("position") - 1).alias("position")), ["conv_id", "turn"], "left")


def query(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))
