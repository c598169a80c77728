"""Mixes of sources to target weights by balanced (cube) sampling."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import cut

#: Documents a flight takes at once; a source of any size is spread over blocks of about this many.
BLOCK = 4096
#: The most tasks a round of flights is spread over.
MOST_TASKS = 2000
SEED = 20261126
_EPS = 1e-9


def flight(tokens: np.ndarray, chances: np.ndarray, seed: int) -> np.ndarray:
    """Move inclusion chances to 0 or 1, keeping their sum and the expected tokens.

    Three open documents leave one direction that changes neither total: the
    null space of (tokens, ones).  A random step along it, of mean zero, closes
    at least one; the next open document takes its place.  At most two stay open.
    """
    rng = np.random.default_rng(seed)
    out = chances.astype(float).tolist()
    size = tokens.astype(float).tolist()
    waiting = [i for i, p in enumerate(out) if _EPS < p < 1 - _EPS]
    rng.shuffle(waiting)
    draws = iter(rng.random(2 * len(waiting) + 3).tolist())
    open_ = [waiting.pop() for _ in range(min(3, len(waiting)))]
    while len(open_) == 3:
        a, b, c = open_
        move = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(move):
            move = (1.0, -1.0, 0.0)
        up = min((1 - out[i]) / m if m > 0 else out[i] / -m for i, m in zip(open_, move) if m)
        down = min(out[i] / m if m > 0 else (1 - out[i]) / -m for i, m in zip(open_, move) if m)
        step = up if next(draws) * (up + down) < down else -down
        for i, m in zip(open_, move):
            out[i] = min(1.0, max(0.0, out[i] + step * m))
            if out[i] < _EPS or out[i] > 1 - _EPS:
                out[i] = round(out[i])
        open_ = [i for i in open_ if 0 < out[i] < 1]
        while len(open_) < 3 and waiting:
            open_.append(waiting.pop())
    return np.array(out)


def land(tokens: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Close the last open documents: of all choices the one nearest in tokens, then in number.

    What is still missing in tokens is made up by trades that keep the number.
    """
    at = np.flatnonzero((chances > 0) & (chances < 1))
    want, number = float((tokens[at] * chances[at]).sum()), float(chances[at].sum())
    best = min(itertools.product((0.0, 1.0), repeat=len(at)), key=lambda c: (abs(float(np.dot(tokens[at], c)) - want), abs(sum(c) - number), c))
    out = chances.copy()
    out[at] = best
    missing = want - float(np.dot(tokens[at], best))
    for _ in range(3):  # trade a used for an unused document while that brings the tokens nearer
        used, free = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
        if not len(used) or not len(free) or abs(missing) < 1:
            break
        free = free[np.argsort(tokens[free], kind="stable")]
        near = np.searchsorted(tokens[free], tokens[used] + missing)
        pairs = [(abs(missing - (tokens[free[k]] - tokens[u])), u, free[k]) for shift in (-1, 0) for u, k in zip(used, near + shift) if 0 <= k < len(free)]
        gap, give, take = min(pairs)
        if gap >= abs(missing):
            break
        out[give], out[take] = 0, 1
        missing -= float(tokens[take] - tokens[give])
    return out


def _fly(group: pd.DataFrame) -> pd.DataFrame:
    """One block's flight; where it is all that is left of its source, the landing too."""
    group = group.sort_values("doc_id", kind="stable").reset_index(drop=True)
    key = "\x1f".join(map(str, (group["mix_name"].iloc[0], group["source"].iloc[0], group["block"].iloc[0], group["blocks"].iloc[0])))
    seed = int(pd.util.hash_array(np.array([key], dtype=object))[0]) ^ SEED
    chances = flight(group["n_tokens"].to_numpy(), group["chance"].to_numpy(), seed)
    group["chance"] = land(group["n_tokens"].to_numpy(float), chances) if group["blocks"].iloc[0] <= 1 else chances
    return group[["mix_name", "source", "doc_id", "n_tokens", "base", "chance", "blocks"]]


def sizes(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Each mix's targets with what the sources have, the mix's size and the expected uses of a document.

    The size is the largest at which no source has to repeat beyond its cap.
    Sources without tokens can't give a share; they don't limit the size and the
    others keep their shares to each other.
    """
    have = tokens.filter("n_tokens > 0 and source is not null").groupBy("source").agg(F.count("*").alias("have_docs"), F.sum("n_tokens").alias("have_tokens"))
    named = targets.filter("mix_name is not null and source is not null and target_share > 0 and max_repeats > 0").groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = named.join(have, "source", "left").fillna(0, ["have_docs", "have_tokens"])
    limit = F.when(F.col("have_tokens") > 0, F.try_divide(F.col("max_repeats") * F.col("have_tokens"), F.col("target_share")))
    sized = joined.withColumn("mix_size", F.min(limit).over(Window.partitionBy("mix_name")))
    return sized.withColumn("uses", F.when(F.col("have_tokens") > 0, F.least(F.try_divide(F.col("target_share") * F.col("mix_size"), F.col("have_tokens")), F.col("max_repeats").cast("double"))))


def usable_documents(tokens: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents a mix may use, each once; of several deliveries the one of most tokens, then of the last source."""
    rows = tokens.filter("doc_id is not null and source is not null and n_tokens > 0")
    return rows.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("d")).select("doc_id", "d.source", "d.n_tokens")


def mix(tokens: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``mix_name, source, doc_id, n_tokens, repeats``: the documents of each mix.

    ``tokens`` has doc_id, source, n_tokens.  A document of a source is expected
    ``uses`` times: the whole part is certain, the rest is drawn by the cube
    method, balanced on tokens and documents.  Flights run in blocks of about
    ``block`` documents, so a source with most of the rows is spread; each block
    leaves at most two open documents, which fly again together until one block
    is left, where the landing closes the last two.

    Defined cases: documents with no tokens, a null id or a null or unnamed
    source are never used; a doc_id given twice counts once; targets with null
    or non-positive parts are ignored; sources without documents give nothing;
    empty tables give no rows; ties are settled by doc_id; the same input gives
    the same mix on any cluster.
    """
    usable = usable_documents(tokens)
    plan = sizes(usable, targets).filter("uses > 0")
    rows = usable.join(plan.select("mix_name", "source", "uses", "have_docs"), "source").withColumn("base", F.floor(F.col("uses") + _EPS).cast("int")).withColumn("chance", F.greatest(F.lit(0.0), F.col("uses") - F.col("base")))
    rows = rows.withColumn("chance", F.when(F.col("chance") < _EPS, 0.0).otherwise(F.col("chance")))
    kept = ["mix_name", "source", "doc_id", "n_tokens", "base", "chance", "blocks"]
    schema = "mix_name string, source string, doc_id bigint, n_tokens int, base int, chance double, blocks bigint"
    rows = rows.withColumn("blocks", F.ceil(F.col("have_docs") / block)).select(kept)
    most, all_blocks = usable.groupBy("source").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("count") / block)), F.lit(1))).first()
    tasks = min(all_blocks, MOST_TASKS)
    blocks, done = -(-most // block), [rows.filter("chance = 0")]
    rows = rows.filter("chance > 0")
    while True:
        number = F.pmod(F.xxhash64("doc_id", "blocks"), F.greatest("blocks", F.lit(1))).cast("int")
        # a task a block, as far as that goes: the blocks are few bytes but much work, and would be joined into one task
        flown = rows.withColumn("block", number).repartition(tasks, "mix_name", "source", "block").groupBy("mix_name", "source", "block").applyInPandas(_fly, schema)
        if blocks <= 1:
            done.append(flown)
            break
        flown = cut(flown)
        done.append(flown.filter("chance = 0 or chance = 1"))
        rows = flown.filter("chance > 0 and chance < 1").withColumn("blocks", F.ceil(2 * F.col("blocks") / block))
        blocks = -(-2 * blocks // block)
    everything = done[0]
    for part in done[1:]:
        everything = everything.unionByName(part)
    return everything.select("mix_name", "source", "doc_id", "n_tokens", (F.col("base") + F.col("chance").cast("int")).alias("repeats")).filter("repeats > 0")


def report(mixed: DataFrame, tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each source in each mix, in tokens, against the documents ``mix`` may use."""
    plan = sizes(usable_documents(tokens), targets).select("mix_name", "source", "target_share", "max_repeats", "have_docs", "have_tokens")
    used = mixed.groupBy("mix_name", "source").agg(F.count("*").alias("docs"), F.sum(F.col("n_tokens").cast("bigint") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    out = plan.join(used, ["mix_name", "source"], "left").fillna(0, ["docs", "tokens", "most_repeats"])
    return out.withColumn("actual_share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy("mix_name"))), F.lit(0.0)))
