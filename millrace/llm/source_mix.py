"""Mixing sources to target weights: subset-sum budget fitting.

Documents are counted by exact token length per source. The total is the largest that every source with documents can
serve within its repeats (or a given one); a source's budget is its share of it. Whole passes over a source come first,
then every length gives its proportional part, and bounded-knapsack dynamic programming over the lengths still free
fills what remains to the token, or as near below as lengths allow. Which documents of a length are taken is decided by a
seeded hash. Only length counts, at most one row per source and length, are gathered per source; documents are ranked
in range partitions, so one source or one length may hold any part of all rows.

Defined results: spellings of a label (case, blanks, ``-`` for ``_``) are one source; a document is a ``doc_id``, and
repeated rows of it count once (least source and token count); NULL and empty texts have no tokens and are not taken;
NULL labels and sources without a target are not taken; a target without documents gets nothing, its share is spread
over the others in proportion and reported; a text of any length counts whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import positions
from ..session import materialize

#: Split pattern of the byte-level vocabulary (fixed value of the public tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def label(c: Column) -> Column:
    """One spelling of a source label."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def knapsack(lengths: list[int], counts: list[int], target: int) -> dict[int, int]:
    """How many of each length add up to the target, or to the nearest sum below it (bounded subset sum on a bitset)."""
    items: list[tuple[int, int]] = []  # (length, how many at once)
    for ln, c in zip(lengths, counts):
        c, k = min(c, target // ln if ln else 0), 1
        while c > 0:
            k = min(k, c)
            items.append((ln, k))
            c -= k
            k *= 2
    mask, reach, seen = (1 << (target + 1)) - 1, 1, [1]
    for ln, k in items:
        reach |= (reach << (ln * k)) & mask
        seen.append(reach)
        if reach >> target & 1:
            break
    rest, out = reach.bit_length() - 1, {}
    for i in range(len(seen) - 1, 0, -1):
        if not seen[i - 1] >> rest & 1:
            ln, k = items[i - 1]
            out[ln] = out.get(ln, 0) + k
            rest -= ln * k
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, max_repeats: int) -> tuple[int, dict[int, int]]:
    """(whole passes, documents per length to be taken once more) for one source's budget."""
    have = int((lengths * counts).sum())
    if not have or budget <= 0 or max_repeats <= 0:
        return 0, {}
    passes = min(budget // have, max_repeats)
    rest = 0 if passes == max_repeats else budget - passes * have
    take = counts * rest // have if rest * int(counts.max()) < 2**62 else np.array([int(c) * rest // have for c in counts])
    left = rest - int((lengths * take).sum())
    out = {int(a): int(t) for a, t in zip(lengths, take)}
    free = {int(a): int(c - t) for a, c, t in zip(lengths, counts, take)}
    # one more of each length while a few of the longest would still fit: the knapsack then has a small target
    small = 4 * int(lengths.max())
    for a in sorted(free, reverse=True):
        if left > small and (n := min(free[a], (left - small) // a)) > 0:
            out[a] += n
            free[a] -= n
            left -= n * a
    order = sorted((a for a in free if free[a] > 0 and a <= left), key=lambda a: (-a * free[a], a))
    for a, n in knapsack(order, [free[a] for a in order], left).items():
        out[a] += n
    return passes, {a: n for a, n in out.items() if n}


@dataclass(frozen=True)
class SourceMix:
    """``total`` None: as much as the sources can serve. ``tokenizer`` is the driver's path of a rank file of a public tokenizer; Spark takes it to the executors."""

    tokenizer: str = TOKENIZER
    total: int | None = None
    seed: int = 42

    def sized(self, docs: DataFrame) -> DataFrame:
        """(doc_id, source, tokens), written once: one row per document."""
        docs.sparkSession.sparkContext.addFile(self.tokenizer)
        name = os.path.basename(self.tokenizer)

        @F.pandas_udf("long")
        def count(texts: pd.Series) -> pd.Series:
            enc = _encoding(SparkFiles.get(name))
            return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

        rows = docs.select(F.col("doc_id"), label(F.col("source")).alias("source"), F.col("text")).filter("doc_id is not null and source is not null")
        each = rows.select("doc_id", "source", count("text").alias("tokens"))
        return materialize(each.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("m")).select("doc_id", "m.*").filter("tokens > 0"), "sized")

    def budgets(self, sized: DataFrame, targets: DataFrame) -> DataFrame:
        """(source, target_share, max_repeats, documents, tokens_there, share, budget): one row per target."""
        t = targets.select(label(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
        t = t.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
        there = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens_there"))
        b = t.join(there, "source", "left").fillna(0, ["documents", "tokens_there"])
        usable = F.when(F.col("tokens_there") > 0, F.col("target_share"))
        # one row per target, so a window over all of them stays as small as the list of targets
        every = Window.partitionBy(F.lit(1))
        b = b.withColumn("usable", F.sum(usable).over(every)).withColumn("least", F.min(F.when(F.col("tokens_there") > 0, F.col("tokens_there") * F.col("max_repeats") / F.col("target_share"))).over(every))
        share = F.coalesce(usable / F.col("usable"), F.lit(0.0))
        total = F.floor(F.col("least") * F.col("usable") + 1e-6)
        if self.total is not None:
            total = F.least(total, F.lit(self.total))
        return b.select("source", "target_share", "max_repeats", "documents", "tokens_there", share.alias("share"), F.floor(share * total + 1e-6).cast("long").alias("budget"))

    def plan(self, sized: DataFrame, budgets: DataFrame) -> DataFrame:
        """(source, tokens, passes, extra, n): per length how many documents are taken passes + 1 times."""
        hist = sized.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")).join(budgets.select("source", "budget", "max_repeats"), "source")

        def work(d: pd.DataFrame) -> pd.DataFrame:
            d = d.sort_values("tokens")
            passes, extra = fit(d["tokens"].to_numpy(np.int64), d["n"].to_numpy(np.int64), int(d["budget"].iloc[0]), int(d["max_repeats"].iloc[0]))
            return pd.DataFrame({"source": d["source"], "tokens": d["tokens"], "passes": passes, "extra": [extra.get(int(x), 0) for x in d["tokens"]], "n": d["n"]})

        return hist.groupBy("source").applyInPandas(work, "source string, tokens long, passes int, extra long, n long")

    def select(self, docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(selection, shares): doc_id, source, tokens, repeats; and per target what it was to give and gives."""
        sized = self.sized(docs)
        budgets = materialize(self.budgets(sized, targets), "budgets")
        plan = materialize(self.plan(sized, budgets), "plan")
        h = F.xxhash64("doc_id", F.lit(self.seed))
        ranked = positions(sized.withColumn("h", h), ["source", "tokens"], [F.col("h"), F.col("doc_id")])
        sel = ranked.join(plan.filter("passes > 0 or extra > 0"), ["source", "tokens"])
        sel = sel.select("doc_id", "source", "tokens", (F.col("passes") + (F.col("pos") < F.col("extra")).cast("int")).alias("repeats")).filter("repeats > 0")
        taken = plan.groupBy("source").agg(F.sum(F.col("tokens") * (F.col("passes") * F.col("n") + F.col("extra"))).alias("tokens_taken"))
        shares = budgets.join(taken, "source", "left").fillna(0, ["tokens_taken"])
        whole = F.sum("tokens_taken").over(Window.partitionBy(F.lit(1)))
        shares = shares.withColumn("all_taken", whole).withColumn("actual_share", F.when(F.col("all_taken") > 0, F.col("tokens_taken") / F.col("all_taken")).otherwise(0.0)).drop("all_taken")
        return sel, shares
