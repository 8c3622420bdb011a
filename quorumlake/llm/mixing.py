"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumlake.llm.shared import materialise

#: Documents that one group of the flight phase holds on average.
GROUP = 2000
#: Fractional documents of a source that are left for the landing.
LANDING = 16
#: A document is taken at most so often.
MOST = 3

_SETTLED = 1e-9


def _move(p: list[float], sizes: list[float], rng: random.Random) -> None:
    """Moves three probabilities (or two) along a direction that keeps their sum and their sum of sizes.

    One of them at least ends at 0 or 1.  Which end is drawn so that each probability keeps its mean.
    """
    if len(p) == 3:
        a, b, c = sizes
        u = [c - b, a - c, b - a]  # orthogonal to (1, 1, 1) and to the sizes
        if not any(u):
            u = [1.0, -1.0, 0.0]
    else:
        u = [1.0, -1.0]
    up = min((1 - x) / d if d > 0 else x / -d for x, d in zip(p, u, strict=True) if d)
    down = min(x / d if d > 0 else (1 - x) / -d for x, d in zip(p, u, strict=True) if d)
    step = up if rng.random() * (up + down) < down else -down
    for i, d in enumerate(u):
        p[i] += step * d
        if p[i] < _SETTLED:
            p[i] = 0.0
        elif p[i] > 1 - _SETTLED:
            p[i] = 1.0


def flight(p: np.ndarray, sizes: np.ndarray, seed: int, stop: int = 2) -> np.ndarray:
    """Flight phase: probabilities after moves in the null space of the totals of sizes and documents.

    At most max(2, stop) of them are left between 0 and 1; memory is that of the input.
    """
    p, sizes, rng = p.astype(float).tolist(), sizes.astype(float).tolist(), random.Random(seed)
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    left = len(open_)
    held: list[int] = []
    rest = iter(open_)
    while left > stop:
        while len(held) < 3 and (i := next(rest, None)) is not None:
            held.append(i)
        if len(held) < 3:
            break
        q = [p[i] for i in held]
        _move(q, [sizes[i] for i in held], rng)
        for i, x in zip(held, q, strict=True):
            p[i] = x
        before, held = len(held), [i for i in held if 0 < p[i] < 1]
        left -= before - len(held)
    return np.array(p)


def landing(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rounds a few fractional documents so that the total of sizes, then of documents, comes nearest to its mean."""
    at = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    if not len(at):
        return out
    choice = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    tokens = np.abs(choice @ sizes[at].astype(float) - p[at] @ sizes[at].astype(float))
    docs = np.abs(choice.sum(axis=1) - p[at].sum())
    out[at] = choice[np.lexsort((docs, np.round(tokens, 6)))[0]]
    return out


def source_targets(sizes: DataFrame, weights: Column | None = None) -> DataFrame:
    """Target of each source: its share by weight of all sizes, at most MOST times its own size.

    sizes: columns source, source_size.  Sources by code point, null last, weigh 1, 2, 3 and so on again unless weights
    (over source and rank, which counts from 1) says otherwise.  What a capped source leaves is shared by weight among
    the rest until none is above its cap; solved in one pass over the sources in order of cap a weight, as the capped
    ones are always the first of that order.  One row a source, so the windows hold few rows.
    """
    weight = weights if weights is not None else ((F.col("rank") - 1) % 3 + 1).cast("double")
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight.cast("double"))
    ranked = ranked.withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    step = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    # the first source whose cap is above the level sets the level of all after it
    step = step.withColumn("free", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")))
    first = F.min(F.when(F.col("free").isNotNull(), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("rank"), F.col("free").alias("level")))).over(everything)
    return step.withColumn("first", first).select("source", "source_size", F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("first.level") * F.col("weight"))).alias("target"))


COLUMNS = ["doc_id", "again", "source", "size", "source_size", "target", "base", "p"]
SCHEMA = "doc_id long, again long, source string, size long, source_size long, target double, base long, p double"


def _settle(seed: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The flight phase of one group, and its landing at the last level; the same rows give the same draws."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "again"], na_position="last", kind="stable")
        own = random.Random(f"{seed} {level} {pdf['source'].iloc[0]} {pdf['part'].iloc[0]}")
        order = list(range(len(pdf)))
        own.shuffle(order)
        pdf = pdf.iloc[order]
        sizes = pdf["size"].to_numpy()
        p = flight(pdf["p"].to_numpy(), sizes, own.getrandbits(60), LANDING if last else LANDING // 2)
        return pdf.assign(p=landing(p, sizes) if last else p)[COLUMNS]

    return settle


def mix(docs: DataFrame, size: Column, seed: int = 0, group: int = GROUP) -> DataFrame:
    """How often a mix of the sources takes each document.

    docs: columns doc_id, source; size: the column to balance, a whole number.  Returns doc_id, source, size,
    source_size, target, copies, taken (copies times size), one row for each row of docs.

    Every document of a source is taken floor(r) times, r being target over size of its source, and once more with
    probability r - floor(r).  The cube method draws these: in hash groups of about ``group`` documents the
    probabilities move in the null space of two totals, sizes and documents, until a few of a group are open; those are
    regrouped and moved on, level by level, until a source has LANDING open ones, which an exhaustive search rounds.
    Only narrow rows are shuffled, no text; a source of any size is split into groups, and the number of levels is the
    logarithm of the number of documents to the base group / 8.

    Nulls: a null source is one source, the last; a null size counts 0; a null doc_id is an id.  Repeated rows are
    documents of their own.  A source of size 0 gets target 0, and its documents are not taken.  An empty table gives
    an empty result.  Groups, order in them and draws depend on the rows and the seed alone, so reruns agree.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    # repeated rows get numbers, by which they are dealt; a row that many hold is spread before it is repeated
    pieces = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / group) - 1))).repartition("doc_id", "size", "piece")
    again = F.explode(F.sequence(F.col("piece") * group, F.least(F.col("n"), (F.col("piece") + 1) * group) - 1)).alias("again")
    rows = materialise(pieces.select("doc_id", "source", "size", again))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = materialise(source_targets(totals.select("source", "source_size")).join(totals.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a third of all rows may be of one source: groups by source and hash, never by source alone
    now = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    now = now.withColumn("base", F.floor(ratio + 1e-12)).withColumn("p", F.greatest(ratio - F.col("base"), F.lit(0.0)))
    open_ = now.select(*COLUMNS, "n")
    done, level = [], 0
    most = targets.agg(F.max("n")).first()[0] or 0
    while True:
        last = most <= group
        key = F.xxhash64("doc_id", "size", "again", F.lit(seed + level))
        dealt = open_.withColumn("part", F.pmod(key, F.greatest(F.lit(1), F.ceil(F.col("n") / group))))

        settled = materialise(dealt.groupBy("source", "part").applyInPandas(_settle(seed, level, last), SCHEMA))
        if last:
            done.append(settled)
            break
        done.append(settled.where("p = 0 or p = 1"))
        rest = settled.where("p > 0 and p < 1")
        counts = rest.groupBy("source").agg(F.count("*").alias("n"))
        open_ = rest.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        most, level = counts.agg(F.max("n")).first()[0] or 0, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.round("p").cast("long")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies, (F.col("size") * (F.col("base") + F.round("p").cast("long"))).alias("taken"))
