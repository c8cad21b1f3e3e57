"""Linking jobs to quote items by exact, normalized and token keys.

Whether and how well a job matches does not depend on the order of jobs, so the four tiers are
one equi-join on (key, tier) and a ranked pick. Which of several candidates a job takes does: jobs
take the first candidate of their key that no job before has taken, through whatever key; when all
are taken, the first. Of a key with n candidates only the first n jobs can find one free. Keys that
share no candidate with another key in use are dealt at once, by place; the others are folded in
the order of jobs, a connected set of keys at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import matching_tokens, normalize_part_number
from .durable import held


def quote_keys(quotes: DataFrame) -> DataFrame:
    """(kind, key, quote_ord): exact, normalized and token keys of part and drawing numbers."""
    dealt = quotes.select("quote_ord", "part_number", "drawing_number").repartition("quote_ord")  # a small file is one task else
    both = dealt.select("quote_ord", F.explode(F.array("part_number", "drawing_number")).alias("p")).filter("trim(p) <> ''")
    keys = F.concat(
        F.array(F.struct(F.lit("exact").alias("kind"), F.lower(F.trim("p")).alias("key"))),
        F.array(F.struct(F.lit("norm").alias("kind"), normalize_part_number(F.col("p")).alias("key"))),
        F.transform(matching_tokens(F.col("p")), lambda t: F.struct(F.lit("token").alias("kind"), t.alias("key"))),
    )
    return both.select("quote_ord", F.inline(keys)).filter("key <> ''").distinct()


def job_keys(jobs: DataFrame) -> DataFrame:
    """(job_ord, tier, pos, kind, key) in order of preference."""
    tokens = lambda c, tier: F.transform(
        matching_tokens(c), lambda t, i: F.struct(F.lit(tier).alias("tier"), i.cast("int").alias("pos"), F.lit("token").alias("kind"), t.alias("key"))
    )
    one = lambda tier, kind, key: F.array(F.struct(F.lit(tier).alias("tier"), F.lit(0).alias("pos"), F.lit(kind).alias("kind"), key.alias("key")))
    spaced = F.col("job_number").rlike(r"[ \t]")
    keys = F.concat(
        one(1, "exact", F.lower(F.trim("part_number"))), one(2, "norm", normalize_part_number(F.col("part_number"))),
        tokens(F.col("part_number"), 3),
        F.when(spaced, tokens(F.col("job_number"), 4)).otherwise(F.array().cast("array<struct<tier:int,pos:int,kind:string,key:string>>")),
    )
    return jobs.select("job_ord", F.inline(keys)).filter("key <> ''")


TIERS = ("exact", "normalized", "token", "job token")
CONFIDENCE = ("exact", "normalized", "normalized", "normalized")
#: Parts that the jobs of one key are ranked in first; steps of labels between two cuts.
SALTS, HOPS = 16, 3


def _best_keys(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """(job_ord, tier, kind, key, n): the best key of each job that any quote has, and its number of quotes."""
    sizes = keys.groupBy("kind", "key").agg(F.count("*").alias("n"))
    return (
        job_keys(jobs).join(sizes, ["kind", "key"])
        .groupBy("job_ord").agg(F.min(F.struct("tier", "pos", "kind", "key", "n")).alias("m"))
        .select("job_ord", "m.tier", "m.kind", "m.key", "m.n")
    )


def match_tiers(jobs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(job_ord, tier, kind, key): the best key of each job that any quote has."""
    return _best_keys(jobs, quote_keys(quotes)).drop("n")


def _by_tier(names: tuple[str, ...]) -> Column:
    out = F.when(F.col("tier") == 1, names[0])
    for i, name in enumerate(names[1:], 2):
        out = out.when(F.col("tier") == i, name)
    return out.otherwise("none")


def _sets(edges: DataFrame) -> DataFrame:
    """edges(kind, key, quote_ord) to (kind, key, label): the least quote that a key is connected with.

    Least labels go from quotes to keys and back, HOPS times between two cuts, until none falls.
    """
    now = edges.withColumn("label", F.col("quote_ord"))
    by_key, by_quote = Window.partitionBy("kind", "key"), Window.partitionBy("quote_ord")
    while True:
        new = now.withColumn("was", F.col("label"))
        for _ in range(HOPS):
            new = new.withColumn("label", F.min("label").over(by_key)).withColumn("label", F.min("label").over(by_quote))
        new = held(new)
        if new.filter("label < was").isEmpty():
            return new.groupBy("kind", "key").agg(F.min("label").alias("label"))
        now = new.drop("was")


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by set: first its candidates (kind, key, quote_ord) in order, then its jobs in order."""
    label, used, free = None, set(), {}
    for frame in frames:
        jobs, quotes = [], []
        for row in frame.itertuples(index=False):
            if row.label != label:
                label, used, free = row.label, set(), {}
            key = (row.kind, row.key)
            if row.turn == 0:
                free.setdefault(key, [0, []])[1].append((row.quote_ord, row.used_as))
                continue
            place, known = own = free[key]
            while place < len(known) and known[place][1] in used:
                place += 1
            own[0] = place  # what is taken stays taken
            quote, name = known[place] if place < len(known) else known[0]
            used.add(name)
            jobs.append(row.job_ord)
            quotes.append(quote)
        if jobs:  # an empty frame has no types that Arrow could tell
            yield pd.DataFrame({"job_ord": jobs, "quote_ord": quotes})


def _taken(jobs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(job_ord, tier, quote_ord) of the jobs that match."""
    keys = held(quote_keys(quotes))
    best = _best_keys(jobs, keys).withColumn("salt", F.pmod(F.xxhash64("job_ord"), F.lit(SALTS)))
    part = Window.partitionBy("kind", "key", "salt").orderBy("job_ord")
    best = held(best.withColumn("k", F.row_number().over(part)))
    early = best.filter("k <= n")
    whole = Window.partitionBy("kind", "key").orderBy("job_ord")
    early = early.withColumn("k", F.row_number().over(whole)).filter("k <= n").select("job_ord", "tier", "kind", "key", "k")
    names = quotes.select("quote_ord", "quote_item_number" if "quote_item_number" in quotes.columns else F.lit(None).cast("string").alias("quote_item_number"))
    names = names.select("quote_ord", F.coalesce(F.nullif(F.col("quote_item_number"), F.lit("")), F.concat(F.lit("#"), F.col("quote_ord").cast("string"))).alias("used_as"))
    asked = keys.join(best.select("kind", "key").distinct(), ["kind", "key"], "left_semi").join(names, "quote_ord")
    place = Window.partitionBy("kind", "key").orderBy("quote_ord")
    # A quote (or another of its item number) that several keys in use reach is contested, and so are those keys.
    shared = F.count("*").over(Window.partitionBy("used_as")) > 1
    cand = asked.withColumn("shared", shared).withColumn("c", F.row_number().over(place))
    cand = held(cand.withColumn("contested", F.max("shared").over(Window.partitionBy("kind", "key"))))
    # The jobs behind the n-th of a key find none free and take its first candidate.
    at = cand.select("kind", "key", "contested", F.col("c").alias("at"), "quote_ord")
    ranked = best.join(early.select("job_ord", F.col("k").alias("at")), "job_ord", "left").withColumn("late", F.col("at").isNull()).fillna(1, ["at"])
    dealt = ranked.join(at, ["kind", "key", "at"]).filter("late or not contested").select("job_ord", "tier", "quote_ord")
    some = cand.filter("contested")
    if some.isEmpty():
        return held(dealt)
    contested = some.select("kind", "key").distinct()
    least = some.groupBy("used_as").agg(F.min("quote_ord").alias("least"))  # quotes of one item number are one
    sets = _sets(some.join(least, "used_as").select("kind", "key", F.col("least").alias("quote_ord")).distinct())
    rows = (
        some.select("kind", "key", "quote_ord", "used_as", "c", F.lit(0).alias("turn"))
        .unionByName(early.join(contested, ["kind", "key"], "left_semi").select("kind", "key", "job_ord", F.lit(1).alias("turn")), allowMissingColumns=True)
        .join(sets, ["kind", "key"])
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    folded = rows.repartition("label").sortWithinPartitions("label", "turn", "c", "job_ord").mapInPandas(
        _fold, f"job_ord {kinds['job_ord']}, quote_ord {kinds['quote_ord']}"
    )
    return held(dealt.unionByName(folded.join(early.select("job_ord", "tier"), "job_ord").select("job_ord", "tier", "quote_ord")))


def link(jobs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Every job with its tier and quote (null if none), job_ord order left to the caller.

    jobs: job_ord (unique), job_number, part_number; quotes: quote_ord (unique), part_number, drawing_number,
    and quote_item_number if quotes of one number are to count as one. confidence is exact, normalized or none.
    """
    return jobs.join(_taken(jobs, quotes), "job_ord", "left").select(
        *jobs.columns,
        F.when(F.col("tier").isNull(), "unmatched").otherwise("matched").alias("status"),
        _by_tier(TIERS).alias("match_type"), _by_tier(CONFIDENCE).alias("confidence"),
        "quote_ord",
    )


def unlinked(quotes: DataFrame, linked: DataFrame) -> DataFrame:
    return quotes.join(linked.filter("quote_ord is not null").select("quote_ord").distinct(), "quote_ord", "left_anti")


def summary(linked: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row: jobs, matched and unmatched, and quotes that no job took."""
    free = unlinked(quotes, linked).select(F.lit("free").alias("status"))
    count = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    return linked.select("status").union(free).agg(
        count("matched", "unmatched").alias("total_jobs"), count("matched").alias("matched_jobs"),
        count("unmatched").alias("unmatched_jobs"), count("free").alias("unmatched_quotes"),
    )
