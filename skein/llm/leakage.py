"""Evaluation texts leaking into training text.

Method: the word n-grams of the held-out items form a hash set that every task holds (the items are few; beyond
``BLOCK_WORDS`` words they pass in blocks, each a broadcast of bounded size and one scan). Every document is normalised
(markup, letter case, punctuation and line breaks undone), its token windows are looked up, and where enough of them hit
one diagonal of an item the hits are verified: runs bridge single exchanged words, and the runs that lie in the item's
order are chained. The words so held, out of all words of the item, are the coverage. Documents are read whole, in
Arrow batches, without a shuffle. What leaked is removed as whole documents or as spans.

The instruction line of a suite is found over all items of the suite, before any block is made.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of items that one task may hold; more items pass in blocks of this size.
BLOCK_WORDS = 2_000_000
GRAM = 3
#: Documents that are looked up together; their words are in memory at once.
DOCUMENTS_AT_ONCE = 500
#: Counters of documents and items that are in memory at once.
PAIRS_AT_ONCE = 5_000_000
#: A run counts when its matched words less this penalty for each exchanged word reach LEAST_RUN. So stretches in which
#: every third word is exchanged make no run; with one in four they do.
LEAST_RUN, PENALTY = 8, 2
#: Tags: short ones whatever is in them, longer ones of attributes with values.
_TAG = re.compile(r"""</?[a-zA-Z][^<>]{0,300}>|<[a-zA-Z][\w:-]*(?:\s++[\w:@.-]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>]++))*+\s*+/?>""")
_TOKEN = re.compile(r"[^\W_]+")
_JOINER = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});?")


def clean(text: str) -> str:
    """The text without markup, entities and invisible joiners; tags leave a gap of their length."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " * len(m[0]), text)
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else _JOINER.sub("", text)


def tokens(text: str) -> list[str]:
    """The lower-case words and numbers of a text."""
    return _TOKEN.findall(clean(text).lower())


def token_places(text: str) -> list[tuple[int, int]]:
    """(begin, end) of every token of ``tokens`` in the text itself. A character that ``clean`` makes of several, or
    leaves out, belongs to the token it stands in."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " * len(m[0]), text)
    out, at, clean_at, own = [], 0, [0], [0]  # the places where clean and own text drift apart
    for m in re.finditer(f"{_ENTITY.pattern}|{_JOINER.pattern}", text):
        new = html.unescape(m[0]) if m[0][0] == "&" else ""
        size = sum(map(len, out))
        out += [text[at : m.start()], new]
        clean_at += [size + m.start() - at, size + m.start() - at + len(new)]
        own += [m.start(), m.end()]
        at = m.end()
    whole = "".join([*out, text[at:]])

    def place(k: int, end: bool) -> int:
        i = (bisect.bisect_left if end else bisect.bisect_right)(clean_at, k) - 1
        return own[max(i, 0)] + k - clean_at[max(i, 0)]

    lower = whole.lower()
    if len(lower) != len(whole):  # a letter whose lower case is two: places are those of the first
        lower = "".join(c.lower()[0] for c in whole)
    return [(place(m.start(), False), place(m.end(), True)) for m in _TOKEN.finditer(lower)]


class ItemIndex:
    """The hash set of the items' n-grams, with the places where each occurs."""

    def __init__(self, items: list[tuple[int, list[str], int]], gram: int = GRAM):
        """items: (id, words, words of its opening that are no passage)."""
        self.gram = gram
        self.ids = [item for item, _, _ in items]
        self.skip = [skip for _, _, skip in items]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype="int64") for _, words, _ in items]
        self.least = [min(LEAST_RUN, len(w) - k) for w, k in zip(self.words, self.skip, strict=True)]
        hashes = [self.hashes(w)[k:] for w, k in zip(self.words, self.skip, strict=True)]
        sizes = [len(h) for h in hashes]
        h = np.concatenate([*hashes, np.zeros(0, "int64")])
        item = np.repeat(np.arange(len(items)), sizes)
        at = np.concatenate([*(np.arange(k, k + n) for n, k in zip(sizes, self.skip, strict=True)), np.zeros(0, "int64")]).astype("int64")
        order = np.argsort(h, kind="stable")
        self.item, self.at = item[order], at[order]
        self.keys, first = np.unique(h[order], return_index=True)
        self.starts = np.append(first, len(h))
        # Seeds that every run has on its diagonal: of m words in h + 1 stretches at least m - 2 (h + 1) windows of three
        # match, and m - 2 h >= least. So nothing that verification would accept is left out for its number of seeds.
        self.seeds = np.array([max(1, n - gram + 1) for n in self.least], dtype="int64")

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        """A hash of every window of ``gram`` words."""
        n = len(ids) - self.gram + 1
        if n <= 0:
            return np.zeros(0, "int64")
        h = np.zeros(n, "uint64")
        for i in range(self.gram):
            h = (h ^ ids[i : i + n].astype("uint64")) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view("int64")

    def lookup(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document position, item, item position) of all seed hits of a document."""
        h = self.hashes(ids)
        if not len(h) or not len(self.keys):
            return (np.zeros(0, "int64"),) * 3
        known = np.lib.stride_tricks.sliding_window_view(ids > 0, self.gram).all(axis=1)
        where = np.nonzero(known)[0]
        slot = np.searchsorted(self.keys, h[where])
        slot[slot == len(self.keys)] = 0
        good = self.keys[slot] == h[where]
        where, slot = where[good], slot[good]
        reps = self.starts[slot + 1] - self.starts[slot]
        index = np.repeat(self.starts[slot] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
        return np.repeat(where, reps), self.item[index], self.at[index]

    def runs(self, doc: np.ndarray, n: int, diagonals: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item start, item end, document start, matched words) of the passages of item n along the diagonals given."""
        own, first, least = self.words[n], self.skip[n], self.least[n]
        out = []
        for d in diagonals.tolist():
            lo, hi = max(first, -d), min(len(own), len(doc) - d)
            at = np.nonzero(own[lo:hi] == doc[lo + d : hi + d])[0].tolist()
            begin = 0
            for k in range(1, len(at) + 1):
                if k == len(at) or at[k] - at[k - 1] > 2:
                    matched, holes = k - begin, at[k - 1] - at[begin] + 1 - (k - begin)
                    if matched - PENALTY * holes >= least:
                        out.append((lo + at[begin], lo + at[k - 1] + 1, lo + d + at[begin], matched))
                    begin = k
        return out

    @staticmethod
    def chain(runs: list[tuple[int, int, int, int]]) -> tuple[int, list[tuple[int, int, int, int]]]:
        """The chain of runs, ascending in item and document, that matches most words. Overlaps count once."""
        runs = sorted(runs)
        best: list[tuple[int, int]] = []
        for i, (a, b, d, m) in enumerate(runs):
            score, before = m, -1
            for j in range(i):
                a2, b2, d2, m2 = runs[j]
                over = max(0, b2 - a, d2 + (b2 - a2) - d)
                if a2 < a and d2 < d and over < min(m, b2 - a2) and best[j][0] + m - over > score:
                    score, before = best[j][0] + m - over, j
            best.append((score, before))
        if not best:
            return 0, []
        i = max(range(len(best)), key=lambda k: best[k][0])
        total, way = best[i][0], []
        while i >= 0:
            way.append(runs[i])
            i = best[i][1]
        return total, way[::-1]

    def search(self, docs: list[list[str]], least: float) -> list[tuple[int, int, float, list[tuple[int, int, int, int]]]]:
        """(document, item id, coverage, runs) of the items of which ``least`` of the words stand in a document.

        The documents are looked up together, as one run of words with a gap that belongs to no item between any two."""
        get = self.vocab.get
        sizes = np.array([len(w) + 1 for w in docs], dtype="int64")
        starts = np.concatenate([[0], np.cumsum(sizes)])
        stream = chain.from_iterable((*map(get, w, repeat(0)), 0) for w in docs)
        ids = np.fromiter(stream, "int64", int(starts[-1]))
        at, item, pos = self.lookup(ids)
        if not len(at):
            return []
        doc = np.searchsorted(starts, at, "right") - 1
        pair = doc * len(self.ids) + item
        # a pair with a run has the run's seeds; most pairs have a few common phrases and are left here, before anything
        # is sorted
        hits = np.bincount(pair, minlength=len(docs) * len(self.ids)).reshape(len(docs), -1)
        kept = (hits >= self.seeds).ravel()[pair]
        pair, at, pos = pair[kept], at[kept], pos[kept]
        # of the rest, the seeds of one diagonal are counted together: a run has all of its seeds on one
        shift = at - pos - starts[pair // len(self.ids)]
        order = np.lexsort((shift, pair))
        pair, shift = pair[order], shift[order]
        first = np.nonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(shift) != 0)]))[0] if len(pair) else np.zeros(0, "int64")
        count = np.diff(np.concatenate([first, [len(pair)]]))
        pair, shift = pair[first], shift[first]
        many = count >= self.seeds[pair % len(self.ids)]
        pair, shift = pair[many], shift[many]
        out = []
        edge = np.concatenate([[0], np.nonzero(np.diff(pair))[0] + 1, [len(pair)]]) if len(pair) else np.zeros(1, "int64")
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            d, n = divmod(int(pair[a]), len(self.ids))
            matched, way = self.chain(self.runs(ids[starts[d] : starts[d + 1] - 1], n, shift[a:b]))
            if (share := matched / len(self.words[n])) >= least:
                out.append((d, self.ids[n], share, way))
        return out


# ---- instruction lines --------------------------------------------------------------------------------------------


def instruction_words(items: DataFrame, least: int = 3) -> DataFrame:
    """(item_id, text, words, skip): the items with their words, and how many of their opening are the instruction line of
    their suite, 0 if there is none. A row delivered twice counts once; null and blank texts, and rows without an id, are
    left out.

    An opening is one if at least ``least`` and half of the distinct texts of the suite share it, or if it is the first
    line of at least ``least`` of them. One that takes up more than half of most of the texts that share it is a common
    passage, and is none. Openings of every length are counted over the whole suite, in one aggregation of their hashes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, suite, text in zip(pdf["item_id"], pdf["suite"], pdf["text"], strict=True):
                head, _, rest = text.lstrip().partition("\n")
                rows.append((item, suite or "", text, tokens(text), len(tokens(head)) if rest.strip() else 0))
            yield pd.DataFrame(rows, columns=["item_id", "suite", "text", "words", "line"])

    rows = items.where("text is not null and item_id is not null").select("item_id", "suite", "text").distinct()
    rows = rows.mapInPandas(read, "item_id bigint, suite string, text string, words array<string>, line int").where("size(words) > 0")
    prefixes = F.aggregate(F.col("words"), F.array().cast("array<bigint>"), lambda a, w: F.concat(a, F.array(F.xxhash64(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)), w))))
    texts = rows.groupBy("suite", "words").agg(F.max("line").alias("line")).withColumn("n", F.size("words"))
    opening = texts.select("suite", F.xxhash64("words").alias("text_key"), "line", "n", F.posexplode(prefixes).alias("k", "h")).withColumn("k", F.col("k") + 1)
    counted = opening.groupBy("suite", "k", "h").agg(F.count("*").alias("shared"), F.sum((2 * F.col("k") <= F.col("n")).cast("int")).alias("roomy"), F.sum((F.col("k") == F.col("line")).cast("int")).alias("lines"))
    sizes = texts.groupBy("suite").agg(F.count("*").alias("size"))
    counted = counted.where(F.col("shared") >= least).join(sizes, "suite")
    roomy = 2 * F.col("roomy") >= F.col("shared")
    counted = counted.withColumns({"common": F.col("shared") >= F.greatest(F.lit(least), F.col("size") / 2), "room": roomy, "first_line": (F.col("lines") >= least) & roomy})
    own = opening.join(counted.where("common or first_line").select("suite", "k", "h", "common", "room", "first_line"), ["suite", "k", "h"]).groupBy("suite", "text_key")
    own = own.agg(F.coalesce(F.max(F.when(F.col("first_line"), F.col("k"))), F.lit(0)).alias("by_line"), F.max(F.when(F.col("common"), F.struct("k", "room"))).alias("c"))
    own = own.select("suite", "text_key", F.greatest("by_line", F.when(F.col("c.room"), F.col("c.k")).otherwise(0)).alias("skip"))
    out = rows.withColumn("text_key", F.xxhash64("words")).join(own, ["suite", "text_key"], "left").withColumn("skip", F.coalesce("skip", F.lit(0)))
    return out.select("item_id", "words", F.min("skip").over(Window.partitionBy("item_id")).alias("skip"))


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[str], int]]]:
    """The items (id, words, words of the instruction line) in blocks that fit a task. Only one block is held at a time.
    Items of fewer than GRAM words besides their instruction line have no passage."""
    block: list[tuple[int, list[str], int]] = []
    size = 0
    for row in instruction_words(items).orderBy("item_id", "words").toLocalIterator():
        if len(row.words) - row.skip < GRAM:
            continue
        if size + len(row.words) > block_words and block:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.words, row.skip))
        size += len(row.words)
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, least: float = 1 / 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, doc_id, coverage, first_word, last_word, passages): documents that hold ``least`` or more of an item's words.

    passages lists the runs by their words in the document, array<struct<begin, end>>; first_word and last_word bound them.
    An item shorter than a run leaks where a document holds it whole. A pair comes once; repeated document rows give
    it again only where their texts differ (the greatest coverage stays). Rows without an id cannot be named and give
    none. Empty tables give no rows. The size of the blocks changes no result."""
    schema = "item_id bigint, doc_id bigint, coverage double, passages array<struct<begin:int,end:int>>"
    spark = documents.sparkSession
    out = None
    for block in item_blocks(items, block_words):
        # a broadcast's values are kept in a file, so the driver holds one block, however many there are
        shared, size = spark.sparkContext.broadcast(block), len(block)

        def scan(batches: Iterator[pd.DataFrame], shared=shared, size: int = size) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            index = ItemIndex(shared.value)
            step = max(1, min(DOCUMENTS_AT_ONCE, PAIRS_AT_ONCE // size))
            for pdf in batches:
                for k in range(0, len(pdf), step):
                    part = pdf.iloc[k : k + step]
                    found = index.search([tokens(t) for t in part["text"]], least)
                    rows = [(item, part["doc_id"].iloc[d], share, [{"begin": at, "end": at + b - a} for a, b, at, _ in way]) for d, item, share, way in found]
                    yield pd.DataFrame(rows, columns=["item_id", "doc_id", "coverage", "passages"])

        hits = documents.where("text is not null and doc_id is not null").select("doc_id", "text").mapInPandas(scan, schema)
        out = hits if out is None else out.unionByName(hits)
        del block
    if out is None:
        out = spark.createDataFrame([], schema)
    best = F.max_by(F.struct("coverage", "passages"), "coverage").alias("b")
    out = out.groupBy("item_id", "doc_id").agg(best).select("item_id", "doc_id", "b.*")
    bounds = [F.element_at("passages", 1)["begin"].alias("first_word"), F.element_at("passages", -1)["end"].alias("last_word")]
    return out.select("item_id", "doc_id", "coverage", *bounds, "passages")


def item_report(leaks: DataFrame) -> DataFrame:
    """(item_id, documents, greatest coverage) of every leaked item."""
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("coverage").alias("coverage"))


def decontaminated(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents without those that hold passages of an item."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


def without_passages(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """(doc_id, text): all documents, those that leaked without the words of the leaked passages, the rest as they are.
    Rows of one doc_id with different texts lose the passages of the text with the greatest coverage from that text only
    if they hold them at the same words; such rows should be told apart first. A null text stays null."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(text, spans, strict=True):
            if t is None or ss is None or not len(ss):
                out.append(t)
                continue
            places, kept, at = token_places(t), [], 0
            for begin, end in sorted((s["begin"], min(s["end"], len(places))) for s in ss):
                if begin < end and (stop := places[end - 1][1]) > at:
                    kept.append(t[at : max(at, places[begin][0])])
                    at = stop
            out.append("".join([*kept, t[at:]]))
        return pd.Series(out, dtype="object")

    spans = leaks.groupBy("doc_id").agg(F.flatten(F.collect_list("passages")).alias("spans"))
    return documents.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", cut("text", "spans").alias("text"))
