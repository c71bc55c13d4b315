"""Evaluation texts leaking into training text: pigeonhole edit matching.

Texts are reduced to words (case, punctuation, white space, line breaks and markup are gone). A passage of ``least`` words with
an error budget of b words falls into b + 1 pieces, one of which must be intact; taken at every offset of an item these are
its runs of ``least // (b + 1)`` words. Hits of pieces in documents are verified by Myers' bit-parallel edit distance of the item's
words from every place near the hit, beginning and ending with a word that both have. Replaced, inserted and dropped words
count alike; the distance alone decides: at most one error in ``rate`` words, over ``least`` words or more. Pairs with fewer intact
pieces than that budget must leave aren't verified (q-gram lemma).

A passage of any length holds one of at most ``longest`` words: cut it at ``least * rate / (rate - 1)`` words from either end, and
one of the parts is within its budget (pigeonhole once more) and stays so, and long enough, when errors at its end are cut off.

How it runs: documents are scanned once, in Arrow batches that become one array of word hashes each. A Bloom filter of the
pieces (``bloom_bits`` bits, so of fixed size whatever the number of items) tells which positions of a document can be hits; their
neighbourhoods, cut into blocks of ``block`` words, are written once and joined with the items' pieces and then their words by
shuffle joins. Items are never gathered; nothing about documents returns to the driver.

Defined results: NULL and empty texts carry nothing; an item shorter than ``least`` words can't leak; the first sentence of
an item that other items share is its general instruction and doesn't count; repeated rows give one row per (doc, item);
very long texts are searched whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import Codes, hash64, split

#: Markup that is no word: tags, targets of links, character references.
MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>|(?<=\])\([^()\s]*\)|&(?:#\d+|#[xX][0-9a-fA-F]+|nbsp|amp|lt|gt|quot);")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Lower-case words without markup."""
    return split(MARKUP.sub(" ", text) if "<" in text or "](" in text or "&" in text else text)


def hashed(batch: list[str], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text)."""
    ws = [words(t) for t in batch]
    n = np.array([len(w) for w in ws], np.int64)
    return codes.of((x for w in ws for x in w), int(n.sum())), n


def myers(pattern: np.ndarray, text: np.ndarray, length: np.ndarray, least: int, rate: int) -> np.ndarray:
    """Which of the pairs match within their budget, all at once: bit-parallel, one 64-bit word per pair.

    ``pattern`` is (pairs, m) with m < 64, of which ``length`` words count, ``text`` is (pairs, columns), padded with what no
    pattern holds. The alignment begins at both first words; it may end after any ``least`` or more words of the pattern at a
    column that equals the last of them, if the edit distance is at most one in ``rate`` of them. Distances of all
    beginnings of the pattern come from one pass: they are the sums of the vertical differences up to their row.
    """
    n, m = pattern.shape
    one, full = np.uint64(1), np.uint64((1 << m) - 1)
    bits = one << np.arange(m, dtype=np.uint64)
    pv, mv, ok = np.full(n, full), np.zeros(n, np.uint64), np.zeros(n, bool)
    most = m // rate
    for j in range(text.shape[1]):
        eq = ((pattern == text[:, j : j + 1]) * bits).sum(axis=1, dtype=np.uint64)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        ph, mh = ((ph << one) | one) & full, (mh << one) & full  # row 0 counts: the match begins here
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        # rows further from the diagonal than the budget can't be within it
        for r in range(max(least, j + 1 - most), min(m, j + 1 + most) + 1):
            upto = np.uint64((1 << r) - 1)
            d = j + 1 + np.bitwise_count(pv & upto).astype(np.int64) - np.bitwise_count(mv & upto)
            ok |= (d <= r // rate) & (r <= length) & ((eq >> np.uint64(r - 1)) & one).astype(bool)
    return ok


def slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a piece in the Bloom filter."""
    u = h.astype(np.int64).view(np.uint64)
    mask = np.uint64(bits - 1)
    return (u & mask).astype(np.int64), ((u >> np.uint64(32)) & mask).astype(np.int64)


def rolling(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k entries."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    u, out = w.astype(np.int64).view(np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        out = out * BASE + u[j : j + n]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


@dataclass(frozen=True)
class LeakScan:
    least: int = 20
    rate: int = 10  # one word in so many may be wrong
    bloom_bits: int = 1 << 23
    block: int = 512

    @property
    def piece(self) -> int:
        return self.least // (self.least // self.rate + 1)

    @property
    def longest(self) -> int:
        """Words of the longest passage that holds no shorter one."""
        return min(63, 2 * -(-self.least * self.rate // (self.rate - 1)) - 1)

    @property
    def budget(self) -> int:
        return self.longest // self.rate

    @property
    def least_hits(self) -> int:
        """Intact pieces that every passage within its budget has (q-gram lemma)."""
        return max(1, min(m - self.piece + 1 - m // self.rate * self.piece for m in range(self.least, self.longest + 1)))

    @property
    def reach(self) -> int:
        return self.longest + self.budget

    def _items(self, items: DataFrame, item_id: str, text: str) -> DataFrame:
        """(item, w): hashed words of items without their general instruction, a first sentence that several items share."""
        t = F.col(f"`{text}`")
        first = F.regexp_extract(t, r"(?s)^\s*(.+?[.?!:])\s", 1)
        i = items.select(F.col(f"`{item_id}`").cast("long").alias("item"), t.alias("text"), first.alias("first")).filter("item is not null and text is not null").distinct()
        shared = i.filter("first <> ''").groupBy("first").agg(F.countDistinct("item").alias("k")).filter("k > 1").select("first", F.lit(True).alias("shared"))
        body = F.when(F.col("shared"), F.expr("substring(ltrim(text), length(first) + 1)")).otherwise(F.col("text"))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = Codes(hash64)
            for b in batches:
                w, n = hashed(b["text"].to_pylist(), codes)
                yield pa.record_batch([b["item"], pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(w))], names=["item", "w"])

        w = i.join(shared, "first", "left").select("item", body.alias("text")).mapInArrow(work, "item long, w array<long>").filter(F.size("w") >= self.least)
        # texts of one item that differ are told apart by their words
        return materialize(w.withColumn("part", F.xxhash64("w")), "items")

    def _pieces(self, items: DataFrame) -> DataFrame:
        """(item, part, p, h): every run of ``piece`` words of every item."""
        k = self.piece

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, part, w in zip(b["item"].to_pylist(), b["part"].to_pylist(), b["w"]):
                    h = rolling(w.values.to_numpy(), k)
                    yield pa.record_batch([pa.array(np.full(len(h), i)), pa.array(np.full(len(h), part)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)], names=["item", "part", "p", "h"])

        return items.mapInArrow(work, "item long, part long, p int, h long")

    def _bloom(self, pieces: DataFrame) -> np.ndarray:
        """The filter as bytes: built by an aggregation into 64-bit words, at most ``bloom_bits`` / 64 of which come back."""
        mask = F.lit(self.bloom_bits - 1).cast("long")
        both = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask)))
        word = pieces.select(both.alias("s")).groupBy(F.shiftright("s", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("v"))
        out = np.zeros(self.bloom_bits // 64, np.int64)
        for r in word.collect():
            out[r.i] = r.v
        return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)

    def _search(self, docs: DataFrame, pieces: DataFrame) -> DataFrame:
        """(doc, block, first, w, pos, h): neighbourhoods of the positions that may be hits, written once."""
        k, reach, size, bits = self.piece, self.reach, self.block, self.bloom_bits
        filt = docs.sparkSession.sparkContext.broadcast(np.packbits(self._bloom(pieces)))  # bloom_bits / 8 bytes
        schema = "doc long, block int, first int, w array<long>, pos array<int>, h array<long>"
        names = [x.split()[0] for x in schema.split(", ")]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there, codes = np.unpackbits(filt.value).astype(bool), Codes(hash64)
            for b in batches:
                w, n = hashed(b["text"].to_pylist(), codes)
                end = np.cumsum(n)
                h = rolling(w, k)
                s1, s2 = slots(h, bits)
                at = np.flatnonzero(there[s1] & there[s2])
                row = np.searchsorted(end, at, "right")
                inside = at + k <= end[row] if len(at) else np.zeros(0, bool)
                at, row = at[inside], row[inside]
                if not len(at):
                    continue
                begin = end - n
                blk = (at - begin[row]) // size
                cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (blk[1:] != blk[:-1])])
                # a block has its own hits and those of a passage that begins with one of them
                over = np.minimum(begin[row[cut]] + (blk[cut] + 1) * size + reach, end[row[cut]])
                stop = np.searchsorted(at, over)
                hits = np.repeat(cut - np.r_[0, np.cumsum(stop - cut)[:-1]], stop - cut) + np.arange((stop - cut).sum())
                lo = np.maximum(begin[row[cut]], at[cut] - reach)
                hi = np.minimum(end[row[cut]], at[stop - 1] + k + reach)
                off = np.r_[0, np.cumsum(hi - lo)].astype(np.int32)
                take = np.repeat(lo - off[:-1], hi - lo) + np.arange(off[-1])
                offs = pa.array(np.r_[0, np.cumsum(stop - cut)].astype(np.int32))
                yield pa.record_batch(
                    [
                        b.column("doc").take(pa.array(row[cut])), pa.array(blk[cut].astype(np.int32)), pa.array((lo - begin[row[cut]]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(off), pa.array(w[take])),
                        pa.ListArray.from_arrays(offs, pa.array((at - begin[row]).astype(np.int32)[hits])), pa.ListArray.from_arrays(offs, pa.array(h[at][hits])),
                    ],
                    names=names,
                )

        return materialize(docs.mapInArrow(work, schema), "near")

    def found(self, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
        """(doc_id, item_id): documents with the items they carry."""
        its = self._items(items, item_id, item_text)
        pieces = materialize(self._pieces(its), "pieces")
        d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).filter("doc is not null and text is not null")
        near = self._search(d, pieces)
        # repeated rows of a document may differ in their text, so the neighbourhood's words are part of its name
        near = near.withColumn("seg", F.xxhash64("doc", "block", "first", "w"))
        hits = near.select("seg", F.explode(F.arrays_zip("pos", "h")).alias("x")).select("seg", "x.pos", "x.h").join(pieces, "h")
        cand = hits.groupBy("seg", "item", "part").agg(F.collect_set(F.struct("p", "pos")).alias("hits"))
        cand = cand.filter(F.size(F.array_distinct("hits.p")) >= self.least_hits)
        cand = cand.join(its.withColumnRenamed("w", "iw"), ["item", "part"]).join(near.select("seg", "doc", "first", "w"), "seg")
        return cand.select("doc", "item", "first", "w", "iw", "hits").mapInArrow(self._verify, "doc_id long, item_id long").distinct()

    def _verify(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size, budget, slack = self.piece, self.longest, self.budget, np.zeros(self.reach, np.int64)
        # every beginning of a passage that holds the piece, with every drift that errors may cause
        back, drift = (x.ravel() for x in np.meshgrid(np.arange(size - k + 1), np.arange(-budget, budget + 1), indexing="ij"))
        for b in batches:
            w, iw, hits = b.column("w"), b.column("iw"), b.column("hits")
            n, m, c = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (w, iw, hits))
            doc, item = np.r_[w.flatten().to_numpy(), slack], np.r_[iw.flatten().to_numpy(), slack]
            doc_end, item_end = np.cumsum(n), np.cumsum(m)
            row = np.repeat(np.arange(b.num_rows), c)
            flat = hits.flatten()
            # places of the hits in the two long arrays
            p = flat.field("p").to_numpy() + (item_end - m)[row]
            q = flat.field("pos").to_numpy() - b.column("first").to_numpy()[row] + (doc_end - n)[row]
            patterns, texts = np.lib.stride_tricks.sliding_window_view(item, size), np.lib.stride_tricks.sliding_window_view(doc, size + budget)
            got = np.zeros(b.num_rows, bool)
            # some thousand hits at a time, those of a row together
            part = np.cumsum(c) // 4000
            for g in np.unique(part):
                own = np.flatnonzero(part[row] == g)
                s = (p[own][:, None] - back).ravel()
                i = (q[own][:, None] - back + drift).ravel()
                r = np.repeat(row[own], len(back))
                ok = (s >= (item_end - m)[r]) & (s + self.least <= item_end[r]) & (i >= (doc_end - n)[r]) & (i < doc_end[r])
                s, i, r = s[ok], i[ok], r[ok]
                ok = item[s] == doc[i]
                # a pair is met once for each intact piece
                _, at, times = np.unique(s[ok] * np.int64(len(doc)) + i[ok], return_index=True, return_counts=True)
                at = at[times >= self.least_hits]
                s, i, r = s[ok][at], i[ok][at], r[ok][at]
                for a in range(0, len(s), 20_000):
                    z = slice(a, a + 20_000)
                    # beyond the neighbourhood's end there is nothing
                    t = np.where(i[z][:, None] + np.arange(size + budget) < doc_end[r[z]][:, None], texts[i[z]], 0)
                    got[r[z][myers(patterns[s[z]], t, item_end[r[z]] - s[z], self.least, self.rate)]] = True
            yield pa.record_batch([b.column("doc").filter(pa.array(got)), b.column("item").filter(pa.array(got))], names=["doc_id", "item_id"])
