"""Mixing sources to target token shares with capped repetition.

Method: cube-method balanced sampling (Deville and Tillé 2004). Every source gets the rate (copies a document) that its
share needs; the whole part of the rate is given to every document, the fraction is an inclusion probability. The
probabilities are moved through the null space of the balancing constraints (document count and tokens), three
documents at a time, so that each move keeps both totals and decides at least one document. Sources are cut into
blocks of bounded size by a hash, so the largest source is many tasks; what a block leaves open (two documents and
some of all sizes) meets in the next, much smaller round, until a source is one block, whose last two documents are
landed by the nearest token total; what is then missing is made up by exchanging documents of that block.

Token counts come from a public tokenizer's rank file, whose path is a parameter. The mix is as large as the caps
allow with all shares exact, or ``total_tokens`` if that is less. Sources that have no tokens, or no target, are
reported with what they lack; the other shares are then in proportion to the rest.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of that rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 2_000
#: Documents of a block that stay open for the next round.
RESERVE = 100


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _shipped(path: str) -> str:
    """The name under which every worker finds the rank file: it goes to them with the job, once a context."""
    sc = SparkSession.active().sparkContext
    sent = sc.__dict__.setdefault("_skein_files", set())
    if path not in sent and os.path.exists(path):
        sc.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def count_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text; null and empty texts have none."""
    name = _shipped(path)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        local = SparkFiles.get(name)
        encode = _encoding(local if os.path.exists(local) else path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def document_sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of documents with an id, tokenised once and kept in the checkpoint folder."""
    return checkpointed(documents.where("doc_id is not null").select("doc_id", "source", count_tokens(F.col("text"), path).alias("n_tokens")))


def mix_plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row for each source of either table: its target, the share it gets, what it has, and the copies a document needs.

    Sources outside the targets keep rate 0. Only two numbers come to the driver, however many sources there are."""
    wanted = targets.where("source is not null").groupBy(F.col("source").alias("wanted")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    totals = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    both = totals.join(wanted, F.col("source") == F.col("wanted"), "full")
    both = checkpointed(both.select(F.coalesce("source", "wanted").alias("source"), zero("target_share", "double"), zero("max_repeats", "int"), zero("documents", "bigint"), zero("tokens", "bigint")))
    usable = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("tokens") > 0)
    whole, most = both.where(usable).agg(F.sum("target_share"), F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).first()
    size = (most or 0.0) * (whole or 0.0)
    size = min(size, total_tokens) if total_tokens is not None else size
    share = F.when(usable, F.col("target_share") / F.lit(whole)).otherwise(0.0)
    rate = F.when(usable, F.least(F.col("max_repeats").cast("double"), F.round(share * F.lit(size) / F.col("tokens"), 12))).otherwise(0.0)
    return both.select("source", "target_share", share.alias("share"), "max_repeats", "documents", "tokens", rate.alias("rate"))


# ---- the cube method ----------------------------------------------------------------------------------------------


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: probabilities moved to 0 or 1 with sum(p) and sum(p * size) kept, but for two documents at most."""
    p = p.astype("float64").copy()
    active = [i for i in range(len(p)) if 1e-9 < p[i] < 1 - 1e-9]
    p[p <= 1e-9], p[p >= 1 - 1e-9] = 0.0, 1.0
    draws = rng.random(len(active) + 1)
    window: list[int] = []
    at = 0
    for k in range(len(active)):
        while len(window) < 3 and at < len(active):
            window.append(active[at])
            at += 1
        if len(window) < 3:
            break
        a, b, c = window
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u[0] == 0 and u[1] == 0:
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) / d if d > 0 else -p[i] / d) for i, d in zip(window, u, strict=True) if d)
        down = min((p[i] / d if d > 0 else (p[i] - 1) / d) for i, d in zip(window, u, strict=True) if d)
        step = up if draws[k] * (up + down) < down else -down
        for i, d in zip(window, u, strict=True):
            p[i] += step * d
            if p[i] <= 1e-9:
                p[i] = 0.0
            elif p[i] >= 1 - 1e-9:
                p[i] = 1.0
        window = [i for i in window if 0 < p[i] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray, need: float) -> np.ndarray:
    """The landing of the documents still open: the choice whose tokens come nearest to ``need``, then whose number does;
    what is then left of ``need`` is made up by exchanging decided documents of the same block."""
    open_ = np.nonzero((p > 0) & (p < 1))[0]
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(open_) if m >> k & 1) - need), abs(bin(m).count("1") - p[open_].sum())))
    out = p.copy()
    for k, i in enumerate(open_):
        out[i] = best >> k & 1
    left = need - float(sum(size[i] * out[i] for i in open_))
    for _ in range(len(p)):  # a document inside for one outside whose size makes up what is left, as long as that helps
        ins, outs = np.nonzero(out == 1)[0], np.nonzero(out == 0)[0]
        if abs(left) < 1 or not len(ins) or not len(outs):
            break
        outs = outs[np.argsort(size[outs], kind="stable")]
        wish = np.searchsorted(size[outs], size[ins] + left)
        j = np.stack([np.clip(wish - 1, 0, len(outs) - 1), np.clip(wish, 0, len(outs) - 1)])
        miss = np.abs(size[outs[j]] - size[ins] - left)
        row, k = np.unravel_index(miss.argmin(), miss.shape)
        if miss[row, k] >= abs(left):
            break
        a, b = ins[k], outs[j[row, k]]
        out[a], out[b] = 0.0, 1.0
        left -= float(size[b] - size[a])
    return out


def _round(open_docs: DataFrame, blocks: Column, seed: int, reserve: int) -> DataFrame:
    """One flight of every block. A source that is one block is landed at once, while its decided documents are at hand;
    where it is several, ``reserve`` documents of each, of all sizes, wait for the next round, so that it has some to exchange."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # the largest first, so that what stays open at the end is small
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        size = pdf["n_tokens"].to_numpy("float64")
        rng = np.random.default_rng([seed, int(pdf["doc_id"].iloc[0]) & 0xFFFFFFFF, len(pdf)])
        p = pdf["p"].to_numpy("float64").copy()
        flown = np.ones(len(p), bool)
        if not pdf["lone"].iloc[0]:
            flown[np.linspace(0, len(p) - 1, min(reserve, len(p))).astype(int)] = False
        p[flown] = flight(p[flown], size[flown], rng)
        if pdf["lone"].iloc[0]:
            still = (p > 0) & (p < 1)
            p = land(p, size, float((p * size)[still].sum()))
        return pdf.assign(p=p)[["doc_id", "source", "n_tokens", "base", "p"]]

    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), blocks)
    # a number given keeps small blocks apart, which would else be put together in one task
    parts = int(open_docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return open_docs.withColumns({"block": block, "lone": blocks == 1}).repartition(parts, "source", "block").groupBy("source", "block").applyInPandas(run, "doc_id bigint, source string, n_tokens bigint, base int, p double")


def balanced_mix(sizes: DataFrame, plan: DataFrame, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents used; copies never exceed the source's cap.

    A document row is a unit: repeated rows of one doc_id are units of their own. Sources without a target, and those
    of rate 0, are not used."""
    used = plan.where("rate > 0").select("source", "rate", F.col("documents").alias("n"))
    base = F.floor(F.col("rate") + 1e-12).cast("int")
    docs = sizes.join(used, "source").withColumn("base", base).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    done = docs.where("p <= 1e-9").select("doc_id", "source", "n_tokens", F.col("base").alias("copies"))
    open_docs = docs.where("p > 1e-9").select("doc_id", "source", "n_tokens", "base", "p", "n")
    largest = used.agg(F.max("n")).first()[0] or 0
    reserve = min(RESERVE, block // 4)
    rounds, n = 1, largest
    while n > block:
        n, rounds = (reserve + 2) * -(-n // block), rounds + 1
    for k in range(rounds):
        # of n documents a round leaves two a block open, and the reserve
        left = F.col("n").cast("double")
        for _ in range(k):
            left = F.when(left <= block, left).otherwise((reserve + 2) * F.ceil(left / block))
        blocks = F.lit(1).cast("bigint") if k == rounds - 1 else F.greatest(F.lit(1), F.ceil(left / block)).cast("bigint")
        after = checkpointed(_round(open_docs, blocks, seed + k, reserve))
        done = done.unionByName(after.where("p = 0 or p = 1").select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("copies")))
        open_docs = after.where("p > 0 and p < 1").join(used.select("source", "n"), "source").select("doc_id", "source", "n_tokens", "base", "p", "n")
    return done.where("copies > 0")


def share_report(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, share, max_repeats, documents, tokens, used_documents, mix_tokens, actual_share, most_copies) of
    every source; a source that is not in the mix has zeros, one without a target a target of 0."""
    got = mix.groupBy("source").agg(F.count("*").alias("used_documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("mix_tokens").alias("all_tokens")).scalar()
    got = got.withColumnRenamed("source", "mixed")
    out = plan.join(got, F.col("source").eqNullSafe(F.col("mixed")), "left").withColumn("all_tokens", total)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    actual = F.round(F.coalesce(F.try_divide(F.col("mix_tokens"), F.col("all_tokens")), F.lit(0.0)), 6).alias("actual_share")
    return out.select("source", "target_share", F.round("share", 6).alias("share"), "max_repeats", zero("documents"), zero("tokens"), zero("used_documents"), zero("mix_tokens"), actual, zero("most_copies"))
