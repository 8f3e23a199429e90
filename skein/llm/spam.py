"""Keyword-stuffed, link-list, menu and tag pages.

Method: bagged decision trees are trained on content and link features from weak labels; page predictions are then
smoothed by the spam rate of the page's host (``source``). The labels come from signals that are no features and may
abstain: the share of function words, that of the page in pieces that read as sentences, that of its first keyword. Features of all pages are computed once and written to the
checkpoint folder; trees are fitted on a bounded sample of weakly labelled pages (``SAMPLE_ROWS``), everything else
(features, host rates, predictions) covers every page. The smoothed vote decides: a page must have more than half of it.
An exact count then confirms that the junk makes up more than half of the page: more than half of the characters are
counted as links, menus, tags, products or keywords, or less than half stand in pieces that read as sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import checkpointed

#: Bound of the labelled sample that the trees are fitted on.
SAMPLE_ROWS = 8_000
#: What is counted of a page; the trees see all but the sums, by which pages are confirmed.
COUNTED = ["link", "menu", "tag", "product", "stuffed", "junk", "density", "distinct", "prose", "links_per_word", "ended", "line_words"]
FEATURES = [c for c in COUNTED if c not in ("junk", "prose", "density")]
#: What pages are labelled by, with the density (words tells whether there is anything to label).
SIGNALS = ["function", "said", "words"]
#: Smoothed vote that a junk page must exceed.
DECIDE = 0.5
#: Share of function words from which a piece is ordinary language, however often its pattern returns.
ORDINARY = 0.4

_ANCHOR = re.compile(r"<a\b[^>]*>.*?</a>", re.S | re.I)
_URL = re.compile(r"(?:https?://|www\.)\S+")
_MENU_COUNT = re.compile(r"[^\d().!?]{1,40} \(\d+\)")
_ENCODED = re.compile(r"\S{50,}")
_WORD = re.compile(r"[^\W\d_]{3,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_MARKS = (" > ", " | ", " / ", " - ", " · ", " • ", " (", "#")
_SEPARATORS = (" > ", " | ", " / ", ", ", " - ", " · ", " • ", "; ", " #")
#: Frequent words of the four languages that are no keywords.
_COMMON = frozenset(
    "the and for that this with from has had have was were are not but its their they them than then who which while when what where will would "
    "could should before after into over under about more most some many each every other one two near said says told only also been being "
    "der die das den dem des und ein eine einen einem eines auf aus bei mit nach seit von vor zum zur ist nun als für nicht sich "
    "les des une est par pas pour dans sur avec que qui son ses aux ans du de la le et "
    "los las una por con para que del sus años ante sin antes como ahora".split()
)
_SHORT = frozenset("a an of to in on at by as is it he she we or if no so up de la le un el y en es et du au il on zu am im an so er es um".split())
_FUNCTION = _COMMON | _SHORT
_ENDS = ".!?…\"'”’)"


def _items(line: str) -> tuple[float, int]:
    """(words per item, items) under the separator that cuts the line into most items."""
    n, cut = 0, ""
    for separator in _SEPARATORS:
        if (k := line.count(separator)) and k >= n:
            n, cut = k, separator
    if n < 5:
        return 99.0, 1
    parts = sum(1 for p in line.split(cut) if p.strip())
    return (len(line.split()) - (cut.strip() not in ("", ",", ";", "#")) * (parts - 1)) / max(1, parts), parts


def page_features(text: str) -> list[float]:
    """The features of one page, as shares of its characters where they are shares. All zero for an empty page."""
    total = len(text.strip())
    if not total:
        return [0.0] * len(COUNTED)
    part = dict.fromkeys(("link", "menu", "tag", "product", "stuffed"), 0)
    n_links = 0
    body = text
    if "<a " in body or "<A " in body:
        found = _ANCHOR.findall(body)
        n_links += len(found)
        part["link"] += sum(map(len, found))
        body = _ANCHOR.sub("\n", body)
    prose: list[str] = []
    lines = [line for raw in text.split("\n") if (line := raw.strip())]
    ended = sum(len(line) for line in lines if line[-1] in _ENDS)
    line_words = min(40.0, len(text.split()) / len(lines))
    urls = "http" in body or "www." in body
    marked = any(s in body for s in _MARKS) or body.count(", ") > 5 or body.count("; ") > 5
    for raw in body.split("\n"):
        line = raw.strip()
        if not line:
            continue
        if urls and (hits := _URL.findall(line)):
            n_links += len(hits)
            size = sum(map(len, hits))
            if len(_WORD.findall(_URL.sub(" ", line))) <= 3 * len(hits) + 2:
                part["link"] += len(line)
            else:
                part["link"] += size
                prose.append(_URL.sub(" ", line))
            continue
        if marked:
            if line.count(" > ") >= 2 or (line[-1] == ")" and _MENU_COUNT.fullmatch(line)):
                part["menu"] += len(line)
                continue
            if line.count(" | ") >= 2 and any(c.isdigit() for c in line):
                part["product"] += len(line)
                continue
            if line.count("#") >= 3 and line.count("#") * 4 >= len(line.split()):
                part["tag"] += len(line)
                continue
            per, n = _items(line)
            if n >= 6 and per <= (2.6 if line.count(", ") == n - 1 else 3.6):
                part["tag"] += len(line)
                continue
        prose.append(line)
    if _ENCODED.search(body):  # encoded blocks and rules are no words
        prose = [line for raw in prose if (line := _ENCODED.sub(" ", raw).strip())]
    words = _WORD.findall("\n".join(prose).lower())
    counts = Counter(words)
    density = 0.0
    if n := max((k for w, k in counts.items() if w not in _COMMON), default=0):
        density = n / len(words)
        if n >= 4 or len(prose) > 8 or sum(k for w, k in counts.items() if w in _COMMON) < 0.1 * len(words):
            part["stuffed"] = _stuffed(prose)
    junk = sum(part.values())
    return [part["link"] / total, part["menu"] / total, part["tag"] / total, part["product"] / total, part["stuffed"] / total, min(1.0, junk / total),
            density, len(counts) / max(1, len(words)), max(0.0, 1 - junk / total), n_links / max(1, len(words)), ended / total, line_words]


def page_signals(text: str) -> list[float]:
    """Of one page: the share of function words, the share of its characters in pieces that read as sentences, with or
    without their full stop, and the number of its words. Encoded blocks count as nothing."""
    body = _ENCODED.sub(" ", text)
    n_words = n_function = said = total = 0
    for line in body.split("\n"):
        for s in _SENTENCE.split(line.strip()):
            words = s.lower().split()
            k = sum(map(_FUNCTION.__contains__, words))
            n_words, n_function, total = n_words + len(words), n_function + k, total + len(s)
            if len(words) >= 5 and k >= 0.12 * len(words):
                said += len(s)
    return [n_function / max(1, n_words), said / max(1, total), float(n_words)]


def _stuffed(prose: list[str]) -> int:
    """Characters of the sentences and short lines that exist for a keyword, and of word heaps without function words.

    Pieces repeated as a whole count once as evidence, and pieces with as many function words as ordinary language has
    are none, so refrains make no keyword, even where their nouns change. Nor does a name: a keyword is written in lower
    case half of the time. Bulleted lines are a list of an article unless nearly all of them hold a keyword."""
    pieces = [s for line in prose for s in (_SENTENCE.split(line) if len(line) > 60 else (line,))]
    bags = {}
    for s in pieces:
        if s not in bags:
            bags[s] = [w for w in _WORD.findall(s.lower()) if w not in _COMMON]
    twice: Counter = Counter()
    short: Counter = Counter()
    heavy, shorts, often_in_one = set(), [], []
    for s, bag in bags.items():
        own = set(bag)
        if len(own) < len(bag) and not _ordinary(s):  # most sentences repeat no word
            again = Counter(bag)
            twice.update(w for w, n in again.items() if n >= 2)
            often_in_one += [(s, w) for w, n in again.items() if n >= 4 and len(bag) >= 8 and n >= 0.15 * len(bag)]
        if len(bag) <= 5 and bag and s[-1] not in ".!?":
            shorts.append((s, bag))
            short.update(own)
        if len(bag) >= 8 and _heap(s):
            heavy.add(s)
    keys = {w for w, n in twice.items() if n >= 3}
    if keys or often_in_one:
        written = Counter(w for s in bags for w in _WORD.findall(s))
        name = {w for w in {*keys, *(w for _, w in often_in_one)} if written[w] < written[w.capitalize()]}
        keys -= name
        heavy.update(s for s, w in often_in_one if w not in name)
    lines: set[str] = set()
    if len(shorts) >= 6:
        often = {w for w, n in short.items() if n >= 3 and n * 10 >= len(shorts)}
        held = [s for s, bag in shorts if often.intersection(bag)]
        bulleted = sum(not s[0].isalnum() for s in held) * 2 > len(held)
        if len(held) >= len(shorts) * (0.9 if bulleted else 0.6):
            lines = set(held)
    size = 0
    for s in pieces:
        bag = bags[s]
        if s in heavy or s in lines or (keys and not keys.isdisjoint(bag) and not _ordinary(s) and any(bag.count(w) >= 2 or (w in bag and len(bag) <= 6) for w in keys)):
            size += len(s) + 1
    return size


def _ordinary(piece: str) -> bool:
    words = piece.lower().split()
    return sum(map(_FUNCTION.__contains__, words)) >= ORDINARY * len(words)


def _heap(piece: str) -> bool:
    """Whether at least ten words follow one another almost without a function word."""
    words = piece.lower().split()
    return len(words) >= 10 and sum(w in _COMMON or w in _SHORT for w in words) < 0.08 * len(words)


# ---- bagged trees -------------------------------------------------------------------------------------------------


class BaggedTrees:
    """Binary classification trees (Gini), each grown on a bootstrap sample over all features; the vote is their mean."""

    def __init__(self, trees: int = 15, depth: int = 5, least: int = 5, seed: int = 7):
        self.n, self.depth, self.least, self.seed, self.trees = trees, depth, least, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BaggedTrees:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.n):
            at = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[at], y[at], self.depth))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> tuple:
        rate = float(y.mean())
        if depth == 0 or len(y) < 2 * self.least or rate in (0.0, 1.0):
            return (rate,)
        best: tuple = (rate * (1 - rate) - 1e-9, None, None)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            k = np.arange(self.least, len(y) - self.least + 1)
            k = k[v[k - 1] < v[np.minimum(k, len(v) - 1)]]
            if not len(k):
                continue
            left, right = c[k - 1] / k, (c[-1] - c[k - 1]) / (len(y) - k)
            impurity = (k * left * (1 - left) + (len(y) - k) * right * (1 - right)) / len(y)
            i = int(impurity.argmin())
            if impurity[i] < best[0]:
                best = (float(impurity[i]), f, float((v[k[i] - 1] + v[k[i]]) / 2))
        if best[1] is None:
            return (rate,)
        below = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[below], y[below], depth - 1), self._grow(x[~below], y[~below], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))

        def walk(node: tuple, rows: np.ndarray) -> None:
            if len(node) == 1:
                out[rows] += node[0]
            elif len(rows):
                below = x[rows, node[0]] <= node[1]
                walk(node[2], rows[below])
                walk(node[3], rows[~below])

        for tree in self.trees:
            walk(tree, np.arange(len(x)))
        return out / max(1, len(self.trees))


# ---- the operator -------------------------------------------------------------------------------------------------


def featurise(documents: DataFrame) -> DataFrame:
    """(doc_id, source, <counts>, <signals>) of every page with an id; a null text counts as empty. Texts are read whole."""
    columns = COUNTED + SIGNALS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = np.array([page_features(t or "") + page_signals(t or "") for t in pdf["text"]], dtype="float64").reshape(len(pdf), len(columns))
            yield pd.concat([pdf[["doc_id", "source"]].reset_index(drop=True), pd.DataFrame(values, columns=columns)], axis=1)

    schema = "doc_id bigint, source string, " + ", ".join(f"{f} double" for f in columns)
    return documents.where("doc_id is not null").select("doc_id", "source", "text").mapInPandas(run, schema)


def weak_label() -> Column:
    """1 for pages with few function words, few sentences or a keyword in every seventh word, 0 for plain prose, null
    (abstained) between and for empty pages. No signal is a feature."""
    few = (F.col("function") < 0.18) & (F.col("said") < 0.75)
    broken = (F.col("said") < 0.4) & (F.col("function") < 0.27)
    keyword = (F.col("density") >= 0.15) & (F.col("function") < 0.35)
    prose = (F.col("function") >= 0.3) & (F.col("said") >= 0.7) & (F.col("density") < 0.08)
    return F.when(F.col("words") == 0, None).when(few | broken | keyword, 1).when(prose, 0)


def train(features: DataFrame, rows: int = SAMPLE_ROWS) -> BaggedTrees | None:
    """Trees fitted on at most ``rows`` labelled pages drawn by a hash of doc_id, half from either label where there are
    as many. None if one of the labels does not occur."""
    labelled = features.withColumn("label", weak_label()).where("label is not null")
    size = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    share = {k: min(1.0, rows / 2 / n) for k, n in size.items()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    drawn = labelled.where(draw < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    # in an order of its own, so that the bootstrap draws alike however the rows are partitioned
    sample = drawn.select("doc_id", *FEATURES, "label").orderBy("doc_id", *FEATURES).limit(2 * rows).toPandas()
    return BaggedTrees().fit(sample[FEATURES].to_numpy("float64"), sample["label"].to_numpy("float64")) if sample["label"].nunique() == 2 else None


def score_pages(documents: DataFrame, host_weight: float = 0.3, host_prior: float = 20.0) -> DataFrame:
    """(doc_id, source, junk, said, worded, p_page, p): the trees' vote and the vote smoothed by the host's mean vote. A vote is
    taken for no surer than its number of trees allows, so that the host counts.

    Hosts with few pages are drawn to the mean of all (``host_prior`` pages); pages without a source form one host.
    Where a label does not occur, the junk share itself is the vote."""
    features = checkpointed(featurise(documents))
    model = train(features)

    @F.pandas_udf("double")
    def vote(*cols: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.column_stack([c.to_numpy("float64") for c in cols])))  # type: ignore[union-attr]

    pages = features.select("doc_id", "source", "junk", "said", (F.col("words") > 0).alias("worded"), (vote(*FEATURES) if model else F.col("junk")).alias("p_page"))
    pages = pages.withColumn("host", F.coalesce("source", F.lit("")))
    rates = pages.groupBy("host").agg(F.sum("p_page").alias("s"), F.count("*").alias("n"))
    mean = rates.agg((F.sum("s") / F.sum("n")).alias("mean")).scalar()
    rates = rates.select("host", "s", "n", mean.alias("mean")).select("host", "mean", ((F.col("s") + host_prior * F.col("mean")) / (F.col("n") + host_prior)).alias("rate"))

    least = 1 / ((model.n if model else 15) + 2)

    def logit(p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
        return F.log(q / (1 - q))

    z = logit(F.col("p_page")) + host_weight * (logit(F.col("rate")) - logit(F.col("mean")))
    return pages.join(rates, "host").select("doc_id", "source", "junk", "said", "worded", "p_page", (1 / (1 + F.exp(-z))).alias("p"))


def is_spam(decide: float = DECIDE) -> Column:
    """The smoothed vote is over ``decide`` and the junk is more than half of the page: by the count, or because less than
    half of the page reads as sentences. A page of nothing but encoded blocks has no words that could be sentences, and is
    none."""
    return (F.col("p") > decide) & ((F.col("junk") > 0.5) | ((F.col("said") < 0.5) & F.col("worded")))


def spam_pages(documents: DataFrame, decide: float = DECIDE) -> DataFrame:
    """(doc_id) of junk pages."""
    return score_pages(documents).where(is_spam(decide)).select("doc_id").distinct()


def host_report(documents: DataFrame) -> DataFrame:
    """(source, pages, spam_pages, spam_rate) of every host."""
    scored = score_pages(documents)
    spam = is_spam().cast("int")
    return scored.groupBy("source").agg(F.count("*").alias("pages"), F.sum(spam).alias("spam_pages"), F.avg(spam).alias("spam_rate"))
