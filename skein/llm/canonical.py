"""Mapping free-entered values to the closest entry of a reference list, reporting those that match none.

Method: the reference entries with their alias paths are put into a trie, which is searched with a Levenshtein automaton:
its state is the row of edit distances (transpositions count one) between the value and the path so far, and a branch is
left as soon as every state exceeds the bound. The bound depends on the value's length. All entries within it come back
(``value_candidates``), best first.

Alias paths are the aliases of the list, what its glosses name, the inflections and derivations of its words by rule,
abbreviations by cutting short, and the entries of a thesaurus, which is an argument.

The rows are reduced to their distinct values before anything is searched, and joined back afterwards. The trie holds a
block of ``BLOCK_PATHS`` paths; a longer list passes in several blocks, whose candidates are put together.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "UNMATCHED"
#: Alias paths that one task holds at a time.
BLOCK_PATHS = 200_000

#: Common words for the terms of the default lists that no rule makes of list, aliases or gloss.
THESAURUS = {
    "PERSON": ["people"], "EVENT": ["evt"], "VEHICLE": ["vessel"], "SATELLITE": ["orbiter"], "ANNOUNCED": ["proclaimed"], "MARRIED_TO": ["wed"], "EVACUATED_FROM": ["fled"], "BORN_IN": ["born at"],
    "LOCATED_IN": ["headquartered in", "in"], "PARTICIPATED_IN": ["joined in", "joined"], "FUNDED_BY": ["gets funds from"], "RELATED_TO": ["pertains to"], "TREATS": ["used to treat"],
}
_LABEL = re.compile(r"^[\W_]*(?:type|kind|label|class|category|tag)[\s_]*[:=\-]+[\s_]*")
_ASIDE = re.compile(r"[\[({][^\])}]*[\])}]")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LEAD = re.compile(r"^(?:the|a|an|is|was|are|were)\s+(?=\S)")
_DIGITS = str.maketrans("01357", "oiest")


@lru_cache(maxsize=65536)
def normalise(value: str) -> str:
    """Lower-case words with single spaces: labels, asides, decoration, accents and digits for letters undone."""
    s = unicodedata.normalize("NFKD", value)
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = _ASIDE.sub(" ", s)
    if not s.isupper():
        s = _CAMEL.sub(" ", s)
    s = _LABEL.sub("", s.casefold())
    words = [w.translate(_DIGITS) if any(c.isalpha() for c in w) else w for w in re.split(r"[\W_]+", s) if w]
    return " ".join(words)


def distance_bound(length: int) -> int:
    """Edits allowed for a value of this many letters."""
    return 0 if length < 4 else 1 if length < 7 else 2


class Trie:
    """Entries with payloads; ``search`` runs the automaton over it."""

    def __init__(self, entries: Iterable[tuple[str, tuple]]):
        self.root: dict = {}
        self.longest = 0
        for key, payload in entries:
            self.longest = max(self.longest, len(key))
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(payload)

    def search(self, word: str, bound: int) -> list[tuple[int, tuple]]:
        """(distance, payload) of every entry within ``bound`` edits of ``word``."""
        found: list[tuple[int, tuple]] = []
        if len(word) > self.longest + bound:
            return found
        first = list(range(len(word) + 1))
        stack = [(c, child, first, None, "") for c, child in self.root.items() if c]
        while stack:
            c, node, row, before, last = stack.pop()
            new = [row[0] + 1]
            for i, w in enumerate(word, 1):
                d = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (w != c))
                if before is not None and i > 1 and w == last and word[i - 2] == c:
                    d = min(d, before[i - 2] + 1)
                new.append(d)
            if new[-1] <= bound and "" in node:
                found += [(new[-1], p) for p in node[""]]
            if min(new) <= bound or min(row) < bound:
                stack += [(k, child, new, row, c) for k, child in node.items() if k]
        return found


# ---- alias paths --------------------------------------------------------------------------------------------------

_ARTICLE = re.compile(r"^(?:(?:a|an|the|other|some|any)\s+)+")
_SMALL = frozenset("by with in to of from at for on".split())
#: Endings by which English derives nouns and forms of a verb; the first are its inflections.
_ENDINGS = ["", "s", "es", "e", "ed", "ing", "er", "or", "ion", "ation", "ition", "itor", "ment", "ant", "ee", "al"]
#: Regular changes of a stem before such endings.
_CHANGES = [("quir", "quisit"), ("ceed", "cess"), ("ish", "icat"), ("iz", ""), ("iz", "ism"), ("iz", "is"), ("i", "y"), ("y", "i"), ("i", "iage"), ("fy", "ficat"), ("scrib", "script"), ("mit", "miss")]


def _plural(words: str) -> str:
    return words[:-1] + "ies" if words.endswith("y") else words + ("es" if words.endswith(("s", "x", "ch")) else "s")


def _singular(words: str) -> str | None:
    return words[:-3] + "y" if words.endswith("ies") else words[:-1] if words.endswith("s") and not words.endswith(("ss", "us", "is")) else None


def verb_forms(word: str) -> list[str]:
    """The inflections and derivations of a verb that is given in any inflection; non-words among them do no harm."""
    stem = re.sub(r"(?:ed|ing|es|s|e)$", "", word) if len(word) > 4 else word
    stems = [stem] + [stem[: len(stem) - len(a)] + b for a, b in _CHANGES if stem.endswith(a) and len(stem) - len(a) >= 2]
    return list(dict.fromkeys(s + e for s in stems for e in _ENDINGS if len(s + e) > 3))


def gloss_paths(gloss: str, entity: bool) -> list[str]:
    """What a gloss names: the members of its list, or what it says that source and target do."""
    text = re.sub(r"\s+", " ", gloss.strip().lower())
    out: list[str] = []
    if entity:
        parts = [_ARTICLE.sub("", p.strip()) for p in re.split(r",|\bor\b|\band\b|\bsuch as\b", text) if p.strip()]
        for p in parts:
            out.append(p)
            if len(parts) > 1:  # one of several kinds: also without what qualifies it
                out.append(re.split(r"\s(?:that|used|put|on|by|reported)\b", p)[0])
                out += [p.split(" ", 1)[1]] if p.split(" ")[0].endswith("ed") and " " in p else []
            out += [m[1] for m in [re.search(r"\bof (\w+)$", p)] if m]
        return [p for p in dict.fromkeys(out) if p]
    for who, said in re.findall(r"the (source|target|two) (.+?)(?= (?:the )?(?:source|target)\b|$)", text):
        said = re.sub(r" the$", "", re.sub(r"^(?:are|is|was|were) ", "", said))
        for p in re.split(r",|\bor\b", said):
            p = _ARTICLE.sub("", p.strip())
            out.append(p)
            out += [m[1] for m in [re.search(r"\b(?:the|that) (\w+(?: of)?)$", p)] if m]
            if p.endswith(" of") and " " in p[:-3].strip() or who == "target" and p.endswith(" of"):
                out += [p.split("the ")[-1], p.split("the ")[-1][:-3]]
            if len(p.split()) == 1:
                out += [f"in {p[:-1]} of"] if p.endswith("s") else []
    return [p for p in dict.fromkeys(out) if len(p) > 2]


def alias_paths(term: str, aliases: Iterable[str], entity: bool, gloss: str | None = None, more: Iterable[str] = ()) -> list[tuple[str, int]]:
    """(path, rank) of one term. Rank 0: the term, 1: its aliases, 2: word forms and what the gloss names, 3: abbreviations
    and heads of aliases (exact matches only unless long)."""
    name = term.replace("_", " ").lower()
    paths = {name: 0}
    for a in [*aliases, *more]:
        if a := normalise(a or ""):
            paths.setdefault(a, 1)
            if " or " in a:  # one path for either side of the "or"
                left, right = a.split(" or ", 1)
                paths.setdefault(" ".join([*left.split(), *[w for w in right.split()[1:] if w in _SMALL]]), 1)
                paths.setdefault(right, 1)
    for g in gloss_paths(gloss or "", entity):
        if g := normalise(g):
            paths.setdefault(g, 2)
    words = name.split()
    if entity:
        for p in list(paths):
            paths.setdefault(_plural(p), min(2, paths[p] + 1))
            if one := _singular(p):
                paths.setdefault(one, 2)
        kinds = [p for p in paths if len(p) > 3]
        if len(words) == 1:  # a kind of it
            for p in kinds:
                if " " not in p and paths[p] == 2:
                    paths.setdefault(f"{p} {name}", 2)
        for a in aliases:
            if len(head := normalise(a or "").split()) > 1 and not _SMALL.intersection(head):
                paths.setdefault(head[-1], 3)
    else:
        tail = [w for w in words[1:] if w in _SMALL]
        for form in verb_forms(words[0]):
            for small in ["", *_SMALL]:
                paths.setdefault(f"{form} {small}".strip(), 2 if small or not tail or len(form) > 4 else 3)
        for p in list(paths):
            if paths[p] < 2:
                paths.setdefault("was " + p, 2)
                paths.setdefault("is " + p, 2)
                paths.setdefault("is the " + p, 2)
    for n in range(3, len(words[0])):  # the first word cut short
        short = " ".join([words[0][:n], *words[1:]])
        paths.setdefault(short, 3)
        if entity and len(words) == 1:
            paths.setdefault(_plural(short), 3)
    return list(paths.items())


def resolve_paths(paths: DataFrame) -> DataFrame:
    """(key, term, rank, size) of paths (key, term, rank): of the terms that share a path those of the least rank own it; an
    abbreviation that several share is dropped."""
    best = paths.groupBy("key", "term").agg(F.min("rank").alias("rank")).groupBy("key").agg(F.min("rank").alias("rank"), F.collect_list(F.struct("term", "rank")).alias("all"))
    owners = F.filter("all", lambda x: x["rank"] == F.col("rank"))
    kept = best.select("key", "rank", owners.alias("owners")).where("rank < 3 or size(owners) = 1")
    return kept.select("key", F.explode("owners.term").alias("term"), "rank", F.length("key").alias("size"))


def reference_paths(terms: DataFrame, field: str, thesaurus: dict[str, list[str]] | None = None) -> DataFrame:
    """The resolved alias paths of one field of the reference list (field, term, aliases, and gloss if there is one)."""
    more = THESAURUS if thesaurus is None else thesaurus
    entity = field.startswith("entity")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for term, aliases, gloss in zip(pdf["term"], pdf["aliases"], pdf["gloss"], strict=True):
                listed = [a for a in aliases if a] if aliases is not None else []
                rows += [(path.replace(" ", ""), term, rank) for path, rank in alias_paths(term, listed, entity, gloss, more.get(term, ()))]
            yield pd.DataFrame(rows, columns=["key", "term", "rank"])

    gloss = F.col("gloss") if "gloss" in terms.columns else F.lit(None).cast("string").alias("gloss")
    rows = terms.where(F.col("field") == field).where("term is not null").select("term", "aliases", gloss)
    return resolve_paths(rows.mapInPandas(run, "key string, term string, rank int"))


# ---- the search ---------------------------------------------------------------------------------------------------


def candidates(value: str, trie: Trie) -> list[tuple[int, int, str]]:
    """(distance, rank, term) of all entries within the bound, best first."""
    norm = normalise(value)
    out: dict[str, tuple[int, int, str]] = {}
    for form in dict.fromkeys([norm, _LEAD.sub("", norm), _LEAD.sub("", _LEAD.sub("", norm))]):
        word = form.replace(" ", "")
        if not word:
            continue
        bound = distance_bound(len(word))
        for d, (term, rank, size) in trie.search(word, bound):
            if d > distance_bound(size) or (rank == 2 and d > 1 + (size >= 9)) or (rank == 3 and d > (size >= 6) + (size >= 9)):
                continue  # what a rule made must be met more closely than what was listed
            key = (d, rank, term)
            if term not in out or key < out[term]:
                out[term] = key
    return sorted(out.values())


def path_blocks(paths: DataFrame, block: int = BLOCK_PATHS) -> Iterator[list[tuple[str, tuple[str, int, int]]]]:
    """The resolved paths in blocks that fit a task; one block is held at a time."""
    part: list[tuple[str, tuple[str, int, int]]] = []
    for r in paths.orderBy("key", "term").toLocalIterator():
        part.append((r.key, (r.term, r.rank, r.size)))
        if len(part) == block:
            yield part
            part = []
    if part:
        yield part


def value_candidates(values: DataFrame, paths: DataFrame, block: int = BLOCK_PATHS) -> DataFrame:
    """(value, term, distance, rank) of all entries within the distance that the length of each value (value) allows. The
    size of the blocks changes no result."""
    spark = values.sparkSession
    # a number given keeps few values apart, which would else be searched in one task
    spread = values.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("value"))
    found = []
    for part in path_blocks(paths, block):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            trie = Trie(shared.value)
            for pdf in batches:
                rows = [(v, term, d, rank) for v in pdf["value"] for d, rank, term in candidates(v, trie)]
                yield pd.DataFrame(rows, columns=["value", "term", "distance", "rank"])

        found.append(spread.mapInPandas(run, "value string, term string, distance int, rank int"))
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "value string, term string, distance int, rank int")
    return out.groupBy("value", "term").agg(F.min(F.struct("distance", "rank")).alias("b")).select("value", "term", "b.distance", "b.rank")


def typed_values(rows: DataFrame, pk: str, column: str, terms: DataFrame, field: str) -> DataFrame:
    """(row_pk, value) once each, of the rows whose value is not null, not blank and not already a term."""
    exact = terms.where(F.col("field") == field).select(F.col("term").alias("value")).where("value is not null").distinct()
    typed = rows.select(F.col(pk).alias("row_pk"), F.col(column).alias("value")).where(F.regexp_replace("value", r"(?U)[\s\x1c-\x1f]+", "") != "")
    return typed.join(exact, "value", "left_anti").distinct()


def map_to_list(rows: DataFrame, pk: str, column: str, terms: DataFrame, field: str, thesaurus: dict[str, list[str]] | None = None, block: int = BLOCK_PATHS) -> DataFrame:
    """(field, row_pk, value, term) of the rows whose value is not null, not blank and not already a term. Ties go to the
    term itself before its aliases, then by name.

    A row delivered twice counts once. With an empty reference list every value is UNMATCHED."""
    once = typed_values(rows, pk, column, terms, field)
    found = value_candidates(once.select("value").distinct(), reference_paths(terms, field, thesaurus), block)
    best = found.groupBy("value").agg(F.min(F.struct("distance", "rank", "term")).alias("b")).select("value", F.col("b.term").alias("term"))
    return once.join(best, "value", "left").select(F.lit(field).alias("field"), "row_pk", "value", F.coalesce("term", F.lit(UNMATCHED)).alias("term"))


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """(field, value, rows) of the values that stand for no entry."""
    return mapped.where(F.col("term") == UNMATCHED).groupBy("field", "value").agg(F.count("*").alias("rows"))
