"""URL filtering: rules by host and path first, else the ratio of two character language models.

Both models are variable-order Markov models of characters: the next character's distribution is interpolated from the
longest context met down to none, each order weighted by how often its context was met and how many characters followed
it (Witten-Bell). They are trained on all different URLs that the rules allow or block and on ``REJECTED_SEEDS``,
hosts of the kind nobody wants; a URL is blocked when its length-normalised log-likelihood under the rejected model
exceeds that under the accepted one by more than a threshold. That is calibrated on the same URLs, each half of them
judged by models of the other half. Counts, likelihoods and the threshold are worked out in Spark; no model is collected.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and is allowed by the method;
blank and very long URLs are scored whole; of rules that fit equally well the first listed wins; without both kinds of
training URLs everything is allowed; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.llm.common import small, stored, table

ORDER = 5
UNIT = 1 << 32
COUNTED = ("allow0", "allow1", "block0", "block1", "seeds")
SEED_WEIGHT = 20
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
REJECTED_SEEDS = [
    "cheap-pills", "buy-pills-online", "spam-farm", "link-farm", "casino-bonus", "free-casino", "online-poker", "best-bets",
    "adult-video", "xxx-cams", "payday-loans", "fast-loans", "replica-watches", "free-money", "win-prize", "miracle-diet",
    "crack-download", "keygen", "malware-download", "phishing-login", "click-bait", "seo-links", "viagra", "cheap-meds",
]


def host_of(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """A struct of the longest fitting rule and its verdict, or null."""
    found = F.lit(None).cast("struct<rule string, verdict string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _pieces(text: Column, order: int) -> Column:
    """Each character of a text, and its end, with the ``order`` characters before it."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            padded = ["\n" * order + t + "\n" for t in batch]
            yield pd.Series([[p[n - order : n + 1] for n in range(order, len(p))] for p in padded], dtype=object)

    return run(text)


# Accepted and rejected counts of a piece; each half of the texts is known to a model of its own, and both to the last one.
KNOWN = {"0": ("allow0", "block0 + seeds"), "1": ("allow1", "block1 + seeds"), "": ("allow0 + allow1", "block0 + block1 + seeds")}


def piece_values(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(piece, value0, value1, value)`` from counts of pieces: how much likelier, as a logarithm, the rejected model of
    either half and of both finds the last character after the others, in units of ``1 / UNIT``.

    Counts of shorter contexts are sums over the longer ones that end in them; each order starts from the one below.
    """
    shorter = None
    for k in range(order + 1):
        here = counts.groupBy(F.expr(f"right(piece, {k + 1})").alias("piece")).agg(*[F.sum(c).alias(c) for c in COUNTED])
        before = F.expr("left(piece, length(piece) - 1)")
        here = here.withColumn("context", before).withColumn("tail", F.expr(f"right(piece, {k})"))
        models = {f"{side}{half}": both[n] for half, both in KNOWN.items() for n, side in enumerate(("a", "b"))}
        here = here.withColumns({f"c_{m}": F.expr(c) for m, c in models.items()})
        of_context = here.groupBy("context").agg(
            *[F.sum(f"c_{m}").alias(f"n_{m}") for m in models], *[F.count_if(F.col(f"c_{m}") > 0).alias(f"k_{m}") for m in models]
        )
        here = here.join(of_context, "context")
        here = here.join(shorter, "tail") if k else here.withColumns({f"p_{m}": F.lit(1 / 4096) for m in models})
        met = {m: (F.col(f"c_{m}") + F.col(f"k_{m}") * F.col(f"p_{m}")) / (F.col(f"n_{m}") + F.col(f"k_{m}")) for m in models}
        met = {m: F.when(F.col(f"n_{m}") > 0, p).otherwise(F.col(f"p_{m}")).alias(f"p_{m}") for m, p in met.items()}
        shorter = stored(here.select(F.col("piece").alias("tail"), *met.values()))
    # Whole numbers, so that their sum does not depend on its order.
    values = [F.round((F.ln(f"p_b{half}") - F.ln(f"p_a{half}")) * UNIT).cast("long").alias(f"value{half}") for half in KNOWN]
    return shorter.select(F.col("tail").alias("piece"), *values)


def scored(texts: DataFrame, seeds: list[str] = REJECTED_SEEDS, order: int = ORDER) -> DataFrame:
    """``(text, verdict, half, difference0, difference1, difference)`` for distinct ``texts(text, verdict)``, none blank.

    All texts with a verdict are counted. A difference is that of the mean log-likelihoods of a character.
    """
    spark = texts.sparkSession
    halved = stored(texts.select("text", "verdict", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")))
    pieces = halved.select("*", F.explode(_pieces(F.col("text"), order)).alias("piece"))
    kinds = [F.count_if((F.col("verdict") == v) & (F.col("half") == h)).alias(f"{v}{h}") for v in ("allow", "block") for h in (0, 1)]
    domains = ("example.com", "example.org", "example.net", "com", "org", "net")
    hosts = spark.createDataFrame([(f"{seed}.{domains[i % 6]}",) for i, seed in enumerate(seeds)], "text string")
    seeded = hosts.select(F.explode(_pieces(F.col("text"), order)).alias("piece")).groupBy("piece").agg((F.count(F.lit(1)) * SEED_WEIGHT).alias("seeds"))
    counts = pieces.groupBy("piece").agg(*kinds).withColumn("seeds", F.lit(0).cast("long"))
    counts = stored(counts.unionByName(seeded, allowMissingColumns=True).fillna(0))
    values = small(stored(piece_values(counts, order)))
    key = [F.xxhash64("text").alias("h0"), F.xxhash64(F.lit(1), "text").alias("h1")]
    sums = pieces.select(*key, "piece").join(values, "piece").groupBy("h0", "h1").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"value{half}").alias(f"value{half}") for half in KNOWN]
    )
    found = halved.select("*", *key).join(sums, ["h0", "h1"])
    return found.select("text", "verdict", "half", *[(F.col(f"value{h}") / F.lit(float(UNIT)) / F.col("n")).alias(f"difference{h}") for h in KNOWN])


def fitted_threshold(found: DataFrame) -> float | None:
    """``best_threshold`` over all texts with a verdict, each judged by the model of the half it is not in.

    None without accepted texts; 0.0 where a half has none or none is rejected. Differences are cut into ranges, counted
    in each and then along them, so no task has them all.
    """
    ruled = found.filter(F.col("verdict").isNotNull())
    kinds = [F.count_if((F.col("verdict") == "allow") & (F.col("half") == h)) for h in (0, 1)]
    allowed0, allowed1, blocked = ruled.agg(*kinds, F.count_if(F.col("verdict") == "block")).first()
    if not allowed0 + allowed1:
        return None
    if not (allowed0 and allowed1 and blocked):
        return 0.0
    other = F.when(F.col("half") == 0, F.col("difference1")).otherwise(F.col("difference0"))
    points = ruled.select(other.alias("d"), (F.col("verdict") == "allow").cast("long").alias("good"), (F.col("verdict") == "block").cast("long").alias("bad"))
    points = points.unionByName(found.sparkSession.createDataFrame([(0.0, 0, 0)], "d double, good long, bad long"))
    points = points.groupBy("d").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ranges = stored(points.repartitionByRange("d")).withColumn("range", F.spark_partition_id())
    totals = ranges.groupBy("range").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    below = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = totals.select("range", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in "gb"])
    upto = Window.partitionBy("range").orderBy("d")
    passed = ranges.withColumns({c: F.sum(c).over(upto) for c in ("good", "bad")}).join(F.broadcast(totals), "range")
    errors = (allowed0 + allowed1 - F.col("good") - F.col("g")) * blocked + (F.col("bad") + F.col("b")) * (allowed0 + allowed1)
    return passed.agg(F.min(F.struct(errors.alias("errors"), F.abs("d").alias("size"), "d")).alias("m")).first().m.d


def best_threshold(good: list[float], bad: list[float]) -> float:
    """The difference, or 0.0, with the least sum of both error rates; of several that nearest to 0.0.

    Errors are counted at each distinct point from the sorted differences and compared as whole numbers.
    """
    points = np.unique([0.0, *good, *bad])
    blocked_good = len(good) - np.searchsorted(np.sort(good), points, "right")
    passed_bad = np.searchsorted(np.sort(bad), points, "right")
    errors = blocked_good * len(bad) + passed_bad * len(good)
    return float(points[np.lexsort((points, np.abs(points), errors))[0]])


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with a struct ``_url`` of host, path, rule, verdict and the models' difference."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    split = pages.withColumn("_host", host).withColumn("_path", path)
    split = split.withColumn("_rule", rule_for(F.col("_host"), F.col("_path"), rules))
    split = split.withColumn("_text", F.concat("_host", "_path"))
    # The rules see host and path only, so a text has one verdict.
    texts = split.filter("_text <> ''").groupBy(F.col("_text").alias("text")).agg(F.first("_rule.verdict").alias("verdict"))
    found = stored(scored(texts))
    threshold = fitted_threshold(found)
    known = small(found.select(F.col("text").alias("_text"), F.col("difference").alias("_difference")))
    marked = split.join(known, "_text", "left").withColumn("_difference", F.coalesce("_difference", F.lit(0.0)) if threshold is not None else F.lit(0.0))
    own = F.when((F.col("_text") != "") & (F.col("_difference") > F.lit(threshold or 0.0)), "block").otherwise("allow")
    verdict = F.coalesce(F.col("_rule.verdict"), own)
    return marked.withColumn(
        "_url", F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.col("_difference").alias("difference"))
    ).drop("_host", "_path", "_rule", "_difference", "_text")


def query(spark, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict")
