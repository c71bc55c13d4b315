"""Template residue and error-page text.

Labelled exemplars of residue (error pages, script notices, filler, unfilled forms, unfilled marks) and of page frames stand
in an inverted index from term to exemplars. A document's prose is cut into passage windows; a window retrieves the
exemplars that share terms with it and is scored by TF-IDF containment: the weight of its terms that the best exemplars of one
label hold, over the weight of all of them. A window is covered above its label's threshold.

* A document is residue if covered words make up ``coverage`` of what is neither page frame nor title. A title is a heading, or a
  line of up to ``title`` terms that stands alone before everything else, if all that follows it is residue.
* Placeholders are terms as well: whatever only a template engine or its user should have replaced becomes one of four marks
  (``MARKS``), which exemplars labelled ``unfilled`` hold. A window above ``unfilled`` is a passage left unfilled. The rest of
  such a window is the template's own text, hence a threshold of its own; one mark in a window of ordinary prose stays below.

Terms are words cut to ``stem`` letters; words with digits or underscores are names and no terms. Titles, code, tags and
marks in quotation marks are removed before. Texts are read once: what is written is an array of small numbers per document (the
exemplars' terms by number, other words, line ends), which is read twice, for document frequencies (counted by Spark over all
documents; as many rows as the exemplars have terms come back to the driver at most) and for the windows. Every other term weighs
as much as the exemplars' mean term.

Defined results: NULL, empty and frame-only texts are no residue; placeholders within code don't count; repeated rows give one
row per document; very long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .exemplars import EXEMPLARS
from .tokens import Codes, split

# What is taken out of a text before its words are read, in this order: (a sign without which there is none, pattern, replacement).
CODE = [
    ("```", r"(?ms)(?:^[ \t]*```|```(?=\w*\n)).*?(?:^[ \t]*```[^\n]*$|\Z)", "\n"),
    ("~~~", r"(?ms)^[ \t]*~~~.*?(?:^[ \t]*~~~[^\n]*$|\Z)", "\n"),
    ("`", r"`[^`\n]*`", " "),
    ("<", r"(?is)<title\b[^>]*>.*?</title>|<(script|style)\b.*?</\1>", " "),
    ("<!--", r"(?s)<!--(.*?)-->", r" \1 "),
    ("#", r"(?m)^\s{0,3}#{1,6}\s.*$", ""),
    ('":', r"\"[^\"\n]*\"\s*:", " "),
    ("] ", r"(?m)^(\s*[-*+]\s+)\[[ xX]\]\s+", r"\1"),
    ("_", r"(?<!\w)_([^_\n]+)_(?!\w)", r"\1"),
]
#: Marks and the forms that become them: delimited names, blanks to be filled, values of nothing, notes of what is to be done.
MARKS = [
    ("mark", "{", r"\{\{[^{}\n]*\}\}|\$\{[^{}\n]*\}|(?<![\w{$\"'])\{[a-z][a-z0-9_ ]*\}(?![\w}])"),
    ("mark", "<", r"<%=?[^%\n]*%>|<[A-Z][A-Z0-9]*(?:[ _][A-Z0-9]+)*>|<(?:insert|enter|your|add|type|fill in)\s[^<>\n]*>"),
    ("mark", "@@", r"@@\w+@@"),
    ("mark", "__", r"(?<!\w)__[A-Za-z]\w*?__(?!\w)"),
    ("mark", "%", r"%[A-Z][A-Z0-9_]*%|%\(\w+\)s"),
    ("mark", "$", r"\$[A-Z][A-Z0-9_]*\$"),
    ("mark", "[", r"\[[A-Z][A-Z0-9]+(?:[ _][A-Z0-9]+)*\](?!\()|\[(?:insert|enter|your|add|type|fill in)\s[^\[\]\n]*\]"),
    ("blank", "[", r"\[\s*\](?!\()"),
    ("blank", "<>", r"(?:(?<=\s)|(?<=\())<>(?!\s*['\"\d])"),
    ("blank", "..", r"\.{6,}|(?<=\s)\.{3}(?=[\s.,:;]|$)"),
    ("blank", "??", r"\?{3,}"),
    ("blank", "__", r"_{4,}"),
    ("blank", "XXX", r"\bXXX+\b"),
    ("null", "[obj", r"\[object Object\]"),
    ("null", "undefined", r"\bundefined\b"),
    ("null", "null", r"(?<!\bis )(?<!\bnot )(?<!\bbe )(?<!\bare )\bnull\b"),
    ("null", "NaN", r"\bNaN\b"),
    ("todo", "TB", r"\bTB[DA]\b"),
    ("todo", "TODO", r"\bTODO\b"),
    ("todo", "FIXME", r"\bFIXME\b"),
]
TAG = r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z:-]+(?:=(?:\"[^\"]*\"|'[^']*'))?)*\s*/?>"
QUOTED = r"[\"“„«‘'](?:[^\"“”„«»‘’'\n\x01-\x04]*[\x01-\x04])+[^\"“”„«»‘’'\n\x01-\x04]*[\"”“»’']"

#: Control characters that stand for the marks within a text, and for the end of a line.
SIGNS = {"mark": "\x01", "blank": "\x02", "null": "\x03", "todo": "\x04"}
LINE = "\x05"
_CODE = [(sign, re.compile(p), by) for sign, p, by in CODE]
_MARKS = [(sign, re.compile(p), f" {SIGNS[name]} ") for name, sign, p in MARKS]
_TAG, _QUOTED, _CONTROL, _NAME = re.compile(TAG), re.compile(QUOTED), re.compile(r"[\x00-\x08]"), re.compile(rb"[\d_]")
OTHER, NAME, END = -1, -2, -3


def prose(text: str) -> list[bytes]:
    """The words of the lines of prose with marks in their places and ``LINE`` at the end of every line."""
    t = _CONTROL.sub(" ", text) if not text.isprintable() else text
    for sign, pattern, by in _CODE:
        if sign in t:
            t = pattern.sub(by, t)
    marked = False
    for sign, pattern, by in _MARKS:
        if sign in t:
            t, k = pattern.subn(by, t)
            marked = marked or k > 0
    if "<" in t:
        t = _TAG.sub(" ", t)
    if marked:
        t = _QUOTED.sub(" ", t)
    return split(t.replace("\n", f" {LINE} ") + f" {LINE}", underscore=True)


def term(w: bytes, stem: int) -> str | None:
    """The term of a word, None if it is a name."""
    return None if _NAME.search(w) else w.decode()[:stem]


def terms_of(text: str, stem: int) -> list[str]:
    """The terms of an exemplar; it names marks as ‹mark›."""
    for name, sign in SIGNS.items():
        text = text.replace(f"‹{name}›", f" {sign} ")
    return [t for w in split(text, underscore=True) if (t := term(w, stem))]


@dataclass
class ResidueIndex:
    """Inverted index of the exemplars with the weights of their terms."""

    exemplars: list[tuple[str, str]] = field(default_factory=lambda: list(EXEMPLARS))
    stem: int = 4
    blend: int = 2

    def __post_init__(self) -> None:
        self.labels = [k for k, _ in self.exemplars]
        self.post: dict[str, list[int]] = defaultdict(list)
        for i, (_, t) in enumerate(self.exemplars):
            for w in set(terms_of(t, self.stem)):
                self.post[w].append(i)
        self.weight: dict[str, float] = {}
        self.other = 1.0

    def weigh(self, df: dict[str, int], n: int) -> None:
        self.weight = {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) + 0.1 for w in self.post}
        self.other = float(np.mean(list(self.weight.values()))) if self.weight else 1.0

    def score(self, window: list[str]) -> dict[str, float]:
        """{label: containment}: what share of the window's weight the label's best exemplars hold.

        ``blend`` exemplars of one label may share a window; each is the one that adds most to those before it.
        """
        tf = Counter(window)
        known = {w: self.weight[w] * k for w, k in tf.items() if w in self.weight}
        total = sum(known.values()) + self.other * sum(k for w, k in tf.items() if w not in self.weight)
        out: dict[str, float] = {}
        left: dict[str, dict[str, float]] = defaultdict(lambda: dict(known))
        for _ in range(self.blend):
            hit: dict[int, float] = defaultdict(float)
            for w in known:
                for e in self.post[w]:
                    hit[e] += left[self.labels[e]].get(w, 0.0)
            best: dict[str, int] = {}
            for e, x in hit.items():
                k = self.labels[e]
                if x > 0 and (k not in best or x > hit[best[k]]):
                    best[k] = e
            for k, e in best.items():
                out[k] = out.get(k, 0.0) + hit[e] / total
                for w in list(left[k]):
                    if e in self.post[w]:
                        del left[k][w]
        return out


@dataclass(frozen=True)
class ResidueFilter:
    window: int = 14
    containment: float = 0.65
    unfilled: float = 0.19
    coverage: float = 0.75
    title: int = 20
    stem: int = 4
    blend: int = 2
    exemplars: tuple[tuple[str, str], ...] = EXEMPLARS

    def _index(self) -> ResidueIndex:
        return ResidueIndex(list(self.exemplars), self.stem, self.blend)

    def coded(self, docs: DataFrame) -> DataFrame:
        """(doc_id, codes) of every document with a text, written once: terms of the index by number, else OTHER, END after lines."""
        number, stem = {t: i for i, t in enumerate(self._index().post)}, self.stem

        def code(w: bytes) -> int:
            if w == LINE.encode():
                return END
            t = term(w, stem)
            return NAME if t is None else number.get(t, OTHER)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = Codes(code)
            for b in batches:
                ws = [prose(t) for t in b["text"].to_pylist()]
                n = np.array([len(w) for w in ws], np.int64)
                c = codes.of((x for w in ws for x in w), int(n.sum())).astype(np.int16)
                keep = c != NAME
                ends = np.r_[0, np.cumsum(keep)][np.r_[0, np.cumsum(n)]].astype(np.int32)
                yield pa.record_batch([b["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(c[keep]))], names=["doc_id", "codes"])

        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).filter("doc_id is not null and text is not null")
        return materialize(d.mapInArrow(work, "doc_id long, codes array<smallint>"), "terms")

    def frequencies(self, coded: DataFrame) -> tuple[dict[str, int], int]:
        """Document frequencies of the exemplars' terms over all documents, and the number of documents.

        What returns to the driver has one row per term of the exemplars at most.
        """
        names = list(self._index().post)
        each = coded.select(F.explode(F.array_append(F.array_distinct("codes"), F.lit(len(names)).cast("smallint"))).alias("c")).filter("c >= 0")
        n = {r.c: r.n for r in each.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {t: n[i] for i, t in enumerate(names) if i in n}, n.get(len(names), 0)

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label, coverage, unfilled, residue) of every document with a text."""
        coded = self.coded(docs)
        index = self._index()
        index.weigh(*self.frequencies(coded))
        size, least, cover, unfilled = self.window, self.containment, self.coverage, self.unfilled
        step, longest_title = max(1, size // 4), self.title
        names = ["doc_id", "label", "coverage", "unfilled", "residue"]
        plain = sorted({*index.labels} - {"unfilled"})
        holds = {k: {t for t, es in index.post.items() if any(index.labels[e] == k for e in es)} for k in plain}
        frame = plain.index("frame") + 1 if "frame" in plain else 0
        terms = list(index.post)
        # by code; the last stands for every other term
        weight = np.array([*(index.weight[t] for t in terms), 0.0])
        is_mark = np.array([*(t in SIGNS.values() for t in terms), False])
        of = {k + 1: np.array([*(t in holds[name] for t in terms), False]) for k, name in enumerate(plain)}

        def decide(marks: np.ndarray, ends: np.ndarray) -> tuple[str | None, float]:
            """Label and covered share of a document from its words' labels and the ends of its lines."""
            content = marks != frame
            begins = np.r_[0, ends[:-1]]
            # blocks are runs of lines that aren't empty; the first that isn't frame may be a title
            full = ends > begins
            head = np.flatnonzero(full & ~np.r_[False, full[:-1]])
            for i in head:
                j = i
                while j + 1 < len(ends) and full[j + 1]:
                    j += 1
                block = slice(begins[i], ends[j])
                if content[block].any():
                    rest = content.copy()
                    rest[: ends[j]] = False
                    if i == j and ends[j] - begins[i] <= longest_title and not marks[block].any() and rest.any() and (marks[rest] > 0).mean() >= cover:
                        content = rest
                    break
            got = marks[content]
            if not len(got) or not (got > 0).any():
                return None, 0.0
            return plain[int(np.bincount(got[got > 0]).argmax()) - 1], float((got > 0).mean())

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[bytes, tuple[int, float]] = {}
            for b in batches:
                flat = b.column("codes").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n_codes = pc.list_value_length(b.column("codes")).to_numpy(zero_copy_only=False).astype(np.int64)
                stop = flat == END
                upto = np.r_[0, np.cumsum(stop)]
                n_lines = np.diff(upto[np.r_[0, np.cumsum(n_codes)]])
                at_end = np.flatnonzero(stop)
                n_words = np.diff(np.r_[-1, at_end]) - 1
                code = flat[~stop]
                got = weight[code]
                whole = np.r_[0, np.cumsum(np.where(code < 0, index.other, got))]
                known = np.r_[0, np.cumsum(got)]
                marked = np.r_[0, np.cumsum(got * is_mark[code])]
                ends = np.cumsum(n_words)
                begin = ends - n_words
                count = np.where(n_words > 0, np.maximum(1, -(-(n_words - step) // step)), 0)
                line = np.repeat(np.arange(len(n_words)), count)
                s = begin[line] + step * (np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count))
                e = np.minimum(s + size, ends[line])
                total = whole[e] - whole[s]
                # no exemplar can hold more than all known terms: most windows end here
                maybe = (known[e] - known[s] >= least * total) | (marked[e] - marked[s] >= unfilled * total)
                marks, left = np.zeros(len(code), np.int8), np.zeros(len(n_words))
                for i in np.flatnonzero(maybe):
                    key = np.sort(code[s[i] : e[i]]).tobytes()
                    if key not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        sc = index.score([terms[c] if c >= 0 else "" for c in code[s[i] : e[i]].tolist()])
                        u = sc.pop("unfilled", 0.0)
                        k = max(sc, key=lambda x: (round(sc[x], 9), x == "frame"), default=None)
                        seen[key] = (plain.index(k) + 1 if k and sc[k] >= least else 0, u)
                    k, u = seen[key]
                    if k:
                        # the passage ends with the words that the label's exemplars hold
                        held = np.flatnonzero(of[k][code[s[i] : e[i]]])
                        marks[s[i] + held[0] : s[i] + held[-1] + 1] = k
                    left[line[i]] = max(left[line[i]], u)
                last = np.cumsum(n_lines)
                hit_line = np.r_[0, np.cumsum((left >= unfilled) | (np.add.reduceat(np.r_[marks, 0], np.minimum(begin, len(marks))) > 0) & (n_words > 0))] if len(n_words) else np.zeros(1)
                out = []
                for doc, z, m in zip(b.column("doc_id").to_pylist(), last, n_lines):
                    a = z - m
                    if hit_line[z] == hit_line[a]:
                        out.append((doc, None, 0.0, 0.0, False))
                        continue
                    lo = begin[a]
                    label, share = decide(marks[lo : ends[z - 1]], ends[a:z] - lo)
                    u = float(left[a:z].max())
                    out.append((doc, "unfilled" if u >= unfilled else label, share, u, u >= unfilled or share >= cover))
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()))], names=names)

        return coded.mapInArrow(work, "doc_id long, label string, coverage double, unfilled double, residue boolean")

    def found(self, docs: DataFrame) -> DataFrame:
        return self.score(docs).filter("residue").select("doc_id", "label").groupBy("doc_id").agg(F.max("label").alias("label"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """The documents without those that are residue; other columns stay, rows without a text as well."""
        bad = self.found(docs).select(F.col("doc_id").alias("__residue"))
        return docs.join(bad, F.col("doc_id").cast("long") == F.col("__residue"), "left_anti")
