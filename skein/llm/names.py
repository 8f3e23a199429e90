"""Linking the variant spellings of persons' and organisations' names.

Method: every name is rewritten to its canonical forms by rules (nickname to given name, initial, titles and middle
names dropped, token order, legal forms and abbreviations, acronym, one letter left out of the distinctive token, so
that typing errors meet); the forms are exploded and equi-joined within the cluster. What meets is scored by the rarity
of the rewriting: a full name speaks for itself (1); an initial, a bare family name or an acronym scores one over the
number of different persons or bodies of that cluster that it may be rewritten from, and is linked above ``LEAST_SCORE``.
Links pass over one full name in between, which joins two different misspellings of it.

The lists only add forms: a name outside them (unlisted given names, three words and more, short names of bodies, single
words) meets its variants under its folded words in any order, abbreviations written out, and a plain pair of words is
read as given and family name as well. Names of the same words are the same, however they are read.

The distinctive token (family name, place or own name of a body) is the key of all joins. Which tokens are misspellings of
one another is found once for the distinct tokens of a cluster, not for every name that bears them; of the bearers of one
token, full names meet only under the same given name. So a common family name costs no pairs of its namesakes; rows are
only joined to names at the end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.graphs import components
from skein.session import checkpointed

#: Given names and the short forms in use for them.
NICKNAMES = {
    "alexander": "alex xander sandy lex al", "christopher": "chris kit topher", "dorothy": "dot dottie dolly", "elizabeth": "liz beth betty lizzie eliza",
    "frederick": "fred freddie freddy", "gregory": "greg", "harold": "hal harry", "isabella": "bella izzy isa", "josephine": "jo josie",
    "katherine": "kate katie kathy kat kit", "lawrence": "larry laurie", "margaret": "maggie meg peggy marge", "michael": "mike mick mickey",
    "nicholas": "nick nico", "oliver": "ollie", "patricia": "pat patty trish", "queenie": "quinn", "richard": "rich rick dick ricky",
    "robert": "rob bob bobby robbie", "samantha": "sam sammy", "theodore": "ted teddy theo", "ursula": "ursa", "victoria": "vicky tori",
    "william": "will bill billy", "yolanda": "yoli", "zachary": "zach zack", "james": "jim jimmy", "john": "jack johnny", "joseph": "joe joey",
    "thomas": "tom tommy", "charles": "charlie chuck", "edward": "ed eddie ned", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny",
    "daniel": "dan danny", "david": "dave", "matthew": "matt", "stephen": "steve", "susan": "sue susie", "jennifer": "jen jenny", "rebecca": "becky",
    "barbara": "barb", "deborah": "debbie", "catherine": "cathy cath", "peter": "pete", "philip": "phil", "ronald": "ron", "donald": "don", "kenneth": "ken",
    "mary": "molly", "anna": "annie", "george": "georgie", "henry": "hank", "leonard": "leo len", "martin": "marty", "timothy": "tim", "walter": "walt",
    "abigail": "abby", "cynthia": "cindy", "gabriel": "gabe", "jacob": "jake", "nathaniel": "nate", "pamela": "pam", "raymond": "ray", "vincent": "vince",
}
#: Titles.
TITLES = frozenset("mr mrs ms miss dr prof professor rev reverend sen senator gov governor capt captain judge sir dame president minister col gen lt sgt fr".split())
#: Abbreviations of words in names of bodies, legal forms among them.
SHORT_FORMS = {
    "assn": "association", "assoc": "association", "fed": "federation", "auth": "authority", "corp": "corporation", "fdn": "foundation", "found": "foundation",
    "natl": "national", "nat": "natural", "comm": "commission", "commn": "commission", "reg": "regional", "hosp": "hospital", "st": "state", "univ": "university",
    "co": "company", "cos": "company", "bdcstg": "broadcasting", "lab": "laboratory", "labs": "laboratory", "intl": "international", "cttee": "committee",
    "cmte": "committee", "dept": "department", "hist": "history", "inst": "institute", "bros": "brothers", "ltd": "limited", "agcy": "agency", "coop": "cooperative",
    "hldgs": "holdings", "ins": "insurance", "med": "medical", "mus": "museum", "res": "research", "govt": "government", "min": "ministry", "inc": "incorporated",
    "bk": "bank", "cham": "chamber", "elec": "electric", "tchrs": "teachers", "tr": "trust", "pub": "public", "wks": "works",
}
#: Words that name a kind of body.
BODY_WORDS = frozenset(
    "association federation authority corporation foundation national natural commission regional hospital state university company broadcasting laboratory "
    "international committee department history institute brothers limited agency cooperative holdings insurance medical museum research government ministry "
    "incorporated bank chamber electric gas public works commerce refugee aid marine food safety energy football teachers farmers river steel housing trust port "
    "transit space airlines council union party office bureau service society club college school church police court group partners".split()
)
#: Letters of a distinctive token up to which each is left out in turn; a longer one misspelt in one place keeps its first
#: or its last LONGEST // 2 letters. Tokens of up to four letters must agree (see ``compatible``).
LONGEST = 60
#: Score that a rewriting must exceed: over one half it may mean one only.
LEAST_SCORE = 0.5
#: Legal forms, which a name may leave out.
LEGAL_FORMS = frozenset("inc incorporated ltd limited llc plc gmbh ag aktiengesellschaft sa nv bv ab oy kg llp spa srl pty corp corporation".split())
_STOP = frozenset("of for and the de du la und y et".split())
_ACRONYM = re.compile(r"(?:[A-Z]{2,7}|(?:[A-Z]\.){2,7})")
_PLAIN = re.compile(r"[^\W\d_][^\W\d_'’-]+(?:['’-][^\W\d_]+)*")
_GIVEN: dict[str, frozenset[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _n in (_full, *_shorts.split()):
        _GIVEN[_n] = _GIVEN.get(_n, frozenset()) | {_full}


class Name(NamedTuple):
    kind: str  # person, body, acronym, or other
    own: str  # family name; place or own name of a body; letters of an acronym
    given: frozenset[str]  # given names it may stand for
    initial: str
    body: tuple[str, ...]
    titled: bool
    loose: bool = False  # read as a person for its shape alone

    @property
    def full(self) -> bool:
        return self.kind == "body" or (self.kind == "person" and bool(self.given))


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def within(a: str, b: str, bound: int = 1) -> bool:
    """Whether the edit distance (transpositions count one) is at most ``bound``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > bound:
        return False
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > bound:
            return False
        before, row = row, new
    return row[-1] <= bound


class Nearby:
    """The words of a list within one edit of a token: both leave a letter out, or not, and come to the same."""

    def __init__(self, words: Iterable[str]):
        self.by: dict[str, list[str]] = {}
        for w in sorted(words):
            for form in self._forms(w):
                self.by.setdefault(form, []).append(w)

    @staticmethod
    def _forms(w: str) -> set[str]:
        return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}

    def __call__(self, token: str) -> set[str]:
        met = {w for form in self._forms(token) for w in self.by.get(form, ())} if len(token) <= LONGEST else set()
        return {w for w in met if within(token, w)}


_FULL_GIVEN = Nearby(NICKNAMES)
_ANY_GIVEN = Nearby(n for n in _GIVEN if len(n) > 3)
_KINDS = Nearby(w for w in BODY_WORDS if len(w) >= 3)
_LINKING = Nearby(("of", "for", "and"))


@lru_cache(maxsize=50_000)
def given_names(token: str) -> frozenset[str]:
    """The given names that a token means, itself or misspelt in one place; empty if none."""
    if token in _GIVEN:
        return _GIVEN[token]
    if len(token) < 4:
        return frozenset()
    return frozenset(_FULL_GIVEN(token)) or frozenset(x for n in _ANY_GIVEN(token) for x in _GIVEN[n])


@lru_cache(maxsize=50_000)
def body_word(token: str) -> str | None:
    """The word of a body's name that a token means; '' for a function word; None for an own name."""
    if token in _STOP:
        return ""
    if token in SHORT_FORMS:
        return SHORT_FORMS[token]
    if token in BODY_WORDS:
        return token
    if len(token) <= 4 and _LINKING(token):
        return ""
    if len(token) >= 3:
        return min(_KINDS(token), default=None)
    return None


@lru_cache(maxsize=200_000)
def parse(name: str) -> Name:
    """The reading of a name."""
    plain = name.strip()
    if _ACRONYM.fullmatch(plain):
        return Name("acronym", plain.replace(".", "").lower(), frozenset(), "", (), False)
    s = re.sub(r"\([^)]*\)|[\"“”'‘’][^\"“”'‘’]{1,20}[\"“”'‘’](?=\s)", " ", plain)
    s = fold(s)
    if " " not in s.strip() and s.count("-") >= 2:
        s = s.replace("-", " ")
    s = s.replace("&", " and ")
    comma = [p.strip() for p in s.split(",") if p.strip()]
    words = [w for w in re.split(r"[\s,]+", s) if w]
    bare = [w.strip(".") for w in words if w.strip(".")]
    # bodies: at least one word for a kind of body besides an own name
    kinds = [body_word(w) for w in bare]
    n_kind = sum(bool(k) for k in kinds)
    exact = sum(bool(k) and (w in BODY_WORDS or w in SHORT_FORMS) for k, w in zip(kinds, bare, strict=True))
    if n_kind >= 1 and exact >= 1 and len([k for k in kinds if k != ""]) >= 3:
        own = [w for w, k in zip(bare, kinds, strict=True) if k is None]
        return Name("body", " ".join(sorted(own)), frozenset(), "", tuple(k for k in kinds if k), False) if own else Name("other", "", frozenset(), "", (), False)
    titled = False
    while bare and bare[0] in TITLES and len(bare) > 1:
        bare, titled = bare[1:], True
    if len(comma) == 2 and len(comma[0].split()) == 1:
        rest = [w.strip(".") for w in comma[1].split() if w.strip(".") and w.strip(".") not in TITLES]
        bare = [*rest, comma[0].strip(".")]
        if not rest:
            return Name("other", "", frozenset(), "", (), False)
        first = rest[0]
    elif len(bare) == 1:
        own = bare[0]
        return Name("person" if own.isalpha() and len(own) > 3 else "other", own, frozenset(), "", (), titled)
    elif len(bare) == 2 or (len(bare) == 3 and len(bare[1]) == 1):
        first = bare[0]
        if len(bare) == 2 and len(first) > 1 and not given_names(first) and (given_names(bare[1]) or len(bare[1]) == 1):
            bare, first = [bare[1], first], bare[1]
    else:
        return Name("other", "", frozenset(), "", (), False)
    own = bare[-1]
    if len(first) == 1:
        return Name("person", own, frozenset(), first, (), titled)
    known = given_names(first)
    if not known and not titled and len(comma) != 2:
        if len(bare) != 2 or exact or not all(_PLAIN.fullmatch(w) for w in bare):
            return Name("other", "", frozenset(), "", (), False)
        return Name("person", own, frozenset([first]), "", (), False, True)
    return Name("person", own, known or frozenset([first]), "", (), titled)


@lru_cache(maxsize=200_000)
def same_words(name: str) -> tuple[str, ...]:
    """The folded words of a name in alphabetic order, without titles, legal forms, function words and punctuation,
    abbreviations written out. A name of nothing else is its own word; empty for a blank name only."""
    plain = name.strip()
    if _ACRONYM.fullmatch(plain):
        return (plain.replace(".", "").lower(),)
    s = fold(plain).replace("&", " and ")
    if " " not in s and s.count("-") >= 2:
        s = s.replace("-", " ")
    words = [w for x in re.split(r"[\s,]+", s) if (w := x.strip(".()\"“”'‘’;:"))]
    while len(words) > 1 and words[0] in TITLES:
        words = words[1:]
    words = [w for w in words if w not in ("the", "of", "for", "and")] or words
    words = words[:1] + [w for w in words[1:] if w not in LEGAL_FORMS]
    return tuple(sorted(SHORT_FORMS.get(w, w) if len(words) > 1 else w for w in words)) or ((plain,) if plain else ())


def acronyms(n: Name, name: str) -> list[str]:
    """The letters that a body's name shortens to."""
    explicit = re.findall(r"\(([A-Z]{2,7})\)", name)
    return list(dict.fromkeys([x.lower() for x in explicit] + ["".join(w[0] for w in (*n.own.split(), *n.body))]))


class Forms(NamedTuple):
    """The canonical rewritings under which a name meets its variants."""

    own: str | None  # the distinctive token behind what kind of name it is of
    given: tuple[str, ...]  # what full names of one token must share, one of these at least
    ends: tuple[str, ...]  # beginning and end of the token, which two misspellings of a full name share
    whole: str | None  # all words
    letters: tuple[str, ...]  # acronyms


def forms(name: str) -> Forms:
    n = parse(name)
    words = same_words(name)
    if not words:
        return Forms(None, (), (), None, ())
    # what the lists read meets under its own forms; the rest, and what may be the same words as the rest, under all words
    whole = " ".join(words)
    if n.kind == "acronym":
        return Forms(None, (), (), whole, (n.own,))
    if n.kind == "other" or not n.own:
        return Forms(None, (), (), whole, ())
    ends = (n.own[:4] + "-", "-" + n.own[-7:]) if n.full and 8 <= len(n.own) <= LONGEST else ()
    if n.kind == "person":
        listed = len(words) == 2 and not n.loose and (n.initial or any(w in n.given or w in _GIVEN for w in words) and n.given <= NICKNAMES.keys())
        ends = tuple(f"{g}:{e}" for g in sorted(n.given) for e in ends)
        return Forms("p\x1f" + n.own, tuple(sorted(n.given)), ends, None if listed else whole, ())
    body = "".join(sorted(w[:2] for w in n.body))
    return Forms(f"o{body}\x1f{n.own}", ("",), ends, None, tuple(acronyms(n, name)))


def sense(name: str) -> str:
    """What tells namesakes of one form apart: the given name, the initial with a star, the opening of an own name."""
    n = parse(name)
    if n.kind == "person":
        return min(n.given) if n.given else n.initial + "*" if n.initial else ""
    return "".join(sorted(n.own[:2])) if n.kind == "body" else ""


def initials(name: str) -> list[str]:
    """The first letters that the given name may have; none if any may be."""
    n = parse(name)
    return sorted({g[0] for g in n.given}) or ([n.initial] if n.initial else [])


def compatible(a: str, b: str) -> bool:
    """Whether two names may denote the same person or body."""
    if same_words(a) and same_words(a) == same_words(b):
        return True
    x, y = parse(a), parse(b)
    if "acronym" in (x.kind, y.kind):
        if x.kind == y.kind:
            return x.own == y.own
        short, long, full = (x, y, b) if x.kind == "acronym" else (y, x, a)
        return long.kind == "body" and short.own in acronyms(long, full)
    if x.kind != y.kind or x.kind == "other":
        return False
    size = min(len(x.own), len(y.own))
    if not within(x.own, y.own, 0 if size <= 4 else 2 if size >= 8 and x.full and y.full else 1):
        return False
    if x.kind == "body":
        return sorted(x.body) == sorted(y.body)
    if x.given and y.given:
        return bool(x.given & y.given)
    if x.initial and y.initial:
        return x.initial == y.initial
    if x.initial or y.initial:
        other = (y if x.initial else x).given
        return not other or any(g[0] == (x.initial or y.initial) for g in other)
    if x.loose or y.loose:  # one word is part of many pairs of words; a title makes it a family name
        return y.titled if x.loose else x.titled
    return bool(x.given or y.given or x.titled or y.titled)


# ---- the operator -------------------------------------------------------------------------------------------------


def name_forms(names: DataFrame) -> DataFrame:
    """(cluster_id, name, full, sense, own, given, ends, whole, letters, initials) of distinct names (cluster_id, name)."""
    schema = "cluster_id string, name string, full boolean, sense string, own string, given array<string>, ends array<string>, whole string, letters array<string>, initials array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, n, parse(n).full, sense(n), *forms(n), initials(n)) for c, n in zip(pdf["cluster_id"], pdf["name"], strict=True)]
            yield pd.DataFrame(rows, columns=["cluster_id", "name", "full", "sense", "own", "given", "ends", "whole", "letters", "initials"])

    return names.mapInPandas(run, schema)


def near_tokens(f: DataFrame) -> DataFrame:
    """(cluster_id, own, own_b): distinctive tokens of a cluster that may be misspellings of one another, both ways. f:
    ``name_forms``."""

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within(x, y, 2) for x, y in zip(a, b, strict=True)], dtype="bool")

    # tokens and forms pass as hashes; the few tokens that meet fetch their letters
    kind, word = F.substring_index("own", "\x1f", 1), F.substring_index("own", "\x1f", -1)
    bears = f.where("own is not null").withColumn("token", F.xxhash64("cluster_id", "own"))
    tokens = bears.select("cluster_id", kind.alias("kind"), word.alias("word"), "own", "token").distinct()
    size, half = F.length("word"), LONGEST // 2
    one_less = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, size)))
    halves = F.array(F.concat(F.substring("word", 1, half), F.lit("-")), F.concat(F.lit("-"), F.right("word", F.lit(half))))
    forms_ = F.when(size > LONGEST, halves).when(size > 4, F.array_distinct(F.concat(F.array("word"), one_less)))
    ends = bears.select("cluster_id", kind.alias("kind"), "token", F.explode("ends").alias("form")).distinct()
    flat = tokens.select("cluster_id", "kind", "token", F.explode(forms_).alias("form")).unionByName(ends).select("token", F.xxhash64("cluster_id", "kind", "form").alias("key"))
    met = flat.join(flat.withColumnRenamed("token", "token_b"), "key").where("token < token_b").select("token", "token_b").distinct()
    other = tokens.select(F.col("token").alias("token_b"), F.col("own").alias("own_b"), F.col("word").alias("word_b"), F.col("kind").alias("k"), F.col("cluster_id").alias("c"))
    named = met.join(tokens, "token").join(other, "token_b").where("c = cluster_id and k = kind")
    close_ones = checkpointed(named.where(close("word", "word_b")).select("cluster_id", "own", "own_b"))
    return close_ones.unionByName(close_ones.select("cluster_id", F.col("own_b").alias("own"), F.col("own").alias("own_b")))


def name_pairs(names: DataFrame) -> DataFrame:
    """(cluster_id, a, full_a, sense_a, b, full_b, sense_b, how): distinct names that meet under a form and may denote the
    same, both ways; how is 2 for names of the same words."""

    @F.pandas_udf("int")
    def may(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([compatible(x, y) * (2 if same_words(x) == same_words(y) else 1) for x, y in zip(a, b, strict=True)], dtype="int32")

    f = checkpointed(name_forms(names))  # read by every join below
    side = lambda df, x, *more: df.select("cluster_id", *more, F.struct("name", "full", "sense", "initials").alias(x))
    alike = (F.size("x.initials") == 0) | (F.size("y.initials") == 0) | F.arrays_overlap("x.initials", "y.initials")
    bears = f.where("own is not null")
    # each bearer meets those of its own token and of the tokens near it
    near = near_tokens(f).groupBy("cluster_id", "own").agg(F.collect_list("own_b").alias("others"))
    meets = bears.join(near, ["cluster_id", "own"], "left").withColumn("to", F.explode(F.concat(F.array("own"), F.coalesce("others", F.array().cast("array<string>")))))
    full = lambda df: df.where("full").withColumn("g", F.explode("given"))
    target = bears.withColumnRenamed("own", "to")
    words = f.where("whole is not null")
    pairs = [  # one side of every join is the full names of one given name, or the few short forms of a token
        side(full(meets), "x", "to", "g").join(side(full(target), "y", "to", "g"), ["cluster_id", "to", "g"]).where("x.name < y.name"),
        side(meets.where("not full"), "x", "to").join(side(target, "y", "to"), ["cluster_id", "to"]).where("x.name < y.name or x.name > y.name and y.full").where(alike),
        side(words, "x", "whole").join(side(words, "y", "whole"), ["cluster_id", "whole"]).where("x.name < y.name"),
    ]
    # full names need not meet under their letters: those are shared by too many, and only an acronym asks for them
    letters = f.withColumn("l", F.explode("letters"))
    pairs.append(side(letters.where("not full"), "x", "l").join(side(letters, "y", "l"), ["cluster_id", "l"]).where("x.name <> y.name and (y.full or x.name < y.name)"))
    met = reduce(DataFrame.unionByName, [p.select("cluster_id", "x", "y") for p in pairs])
    may_be = met.withColumn("how", may("x.name", "y.name")).where("how > 0")
    ordered = may_be.select("cluster_id", *[F.when(F.col("x.name") < F.col("y.name"), F.col(p)).otherwise(F.col(q)).alias(r) for p, q, r in (("x", "y", "x"), ("y", "x", "y"))], "how").distinct()
    once = checkpointed(ordered)  # the pairs of namesakes only, read by every rule
    # both directions are kept: each side's rewriting is judged by what else it may mean
    flat = lambda p, q: once.select("cluster_id", *[F.col(f"{u}.{c}").alias(f"{c}_{v}" if c != "name" else v) for u, v in ((p, "a"), (q, "b")) for c in ("name", "full", "sense")], "how")
    return flat("x", "y").unionByName(flat("y", "x"))


def name_links(names: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """(cluster_id, name_a, name_b) of distinct names (cluster_id, name) that denote the same; name_a < name_b."""
    pairs = name_pairs(names)
    strong = pairs.where("full_a and full_b or how = 2").select("cluster_id", "a", "b")
    weak = pairs.where("not full_a or not full_b")
    meanings = weak.where("not full_a and sense_b <> ''").groupBy("cluster_id", "a").agg(F.collect_set("sense_b").alias("senses"))
    full = F.filter("senses", lambda s: ~s.endswith("*"))
    lone = F.filter("senses", lambda s: s.endswith("*") & ~F.exists(full, lambda g: F.substring(g, 1, 1) == F.substring(s, 1, 1)))
    score = F.try_divide(F.lit(1.0), F.size(full) + F.size(lone))  # null where there is nothing that it may mean
    single = meanings.where(F.coalesce(score, F.lit(1.0)) > least_score).select("cluster_id", F.col("a").alias("name"), F.element_at(F.concat(full, lone, F.array(F.lit(""))), 1).alias("meant"))
    to_full = weak.where("not full_a and full_b").join(single.withColumnRenamed("name", "a"), ["cluster_id", "a"]).select("cluster_id", "a", "b")
    both = weak.where("not full_a and not full_b and a < b")
    sa, sb = single.select("cluster_id", F.col("name").alias("a"), F.col("meant").alias("meant_a")), single.select("cluster_id", F.col("name").alias("b"), F.col("meant").alias("meant_b"))
    known = weak.where("not full_a").groupBy("cluster_id", "a").agg(F.max(F.col("sense_b") != "").alias("has"))
    both = both.join(sa, ["cluster_id", "a"], "left").join(sb, ["cluster_id", "b"], "left")
    both = both.join(known.withColumnRenamed("has", "has_a"), ["cluster_id", "a"]).join(known.select("cluster_id", F.col("a").alias("b"), F.col("has").alias("has_b")), ["cluster_id", "b"])
    sure = (F.col("meant_a").isNotNull() | ~F.col("has_a")) & (F.col("meant_b").isNotNull() | ~F.col("has_b"))
    ma, mb = F.coalesce("meant_a", F.lit("")), F.coalesce("meant_b", F.lit(""))
    agree = (ma == "") | (mb == "") | (F.substring(ma, 1, 1) == F.substring(mb, 1, 1))
    both = both.where(sure & agree).select("cluster_id", "a", "b")
    back = lambda df: df.unionByName(df.select("cluster_id", F.col("b").alias("a"), F.col("a").alias("b")))
    edges = strong.unionByName(back(to_full)).unionByName(back(both))
    # over one name in between that is full or can mean one only: two misspellings, or a short form and a misspelling
    hubs = strong.unionByName(back(to_full))
    over = hubs.select("cluster_id", F.col("b").alias("hub"), "a").join(hubs.select("cluster_id", F.col("b").alias("hub"), F.col("a").alias("c")), ["cluster_id", "hub"])
    over = over.where("a < c").select("cluster_id", "a", F.col("c").alias("b"))
    links = edges.where("a < b").unionByName(over).distinct()
    return links.select("cluster_id", F.col("a").alias("name_a"), F.col("b").alias("name_b"))


def linked_rows(entities: DataFrame) -> DataFrame:
    """(entity_pk_a, entity_pk_b): pairs of rows of one cluster whose different names denote the same; a < b.

    Null and blank names, and rows without a cluster, are linked to nothing; a row delivered twice counts once."""
    rows = entities.where("name is not null and cluster_id is not null").select("entity_pk", "cluster_id", "name").distinct()
    links = name_links(rows.select("cluster_id", "name").distinct())
    a = rows.select(F.col("entity_pk").alias("pk_a"), "cluster_id", F.col("name").alias("name_a"))
    b = rows.select(F.col("entity_pk").alias("pk_b"), "cluster_id", F.col("name").alias("name_b"))
    pairs = links.join(a, ["cluster_id", "name_a"]).join(b, ["cluster_id", "name_b"]).where("pk_a <> pk_b")
    return pairs.select(F.least("pk_a", "pk_b").alias("entity_pk_a"), F.greatest("pk_a", "pk_b").alias("entity_pk_b")).distinct()


def variant_report(entities: DataFrame) -> DataFrame:
    """(cluster_id, name, spellings): for each name the number of other spellings linked to it."""
    names = entities.where("name is not null and cluster_id is not null").select("cluster_id", "name").distinct()
    links = name_links(names)
    ends = links.select("cluster_id", F.explode(F.array("name_a", "name_b")).alias("name"))
    return ends.groupBy("cluster_id", "name").agg(F.count("*").alias("spellings"))


def variant_classes(entities: DataFrame) -> DataFrame:
    """(entity_pk, class_id, spellings): every row with a cluster and a name once, with the least entity_pk of the rows that
    denote the same as it, along links, and the number of other spellings of its cluster that its name is linked to.

    Copies of one name are members of its class and not expanded to pairs."""
    rows = entities.where("name is not null and cluster_id is not null and entity_pk is not null").select("entity_pk", "cluster_id", "name").distinct()
    mark = lambda c: F.concat_ws("\x1f", "cluster_id", c)
    names = rows.groupBy("cluster_id", "name").agg(F.min("entity_pk").alias("first")).withColumn("v", mark("name"))
    links = checkpointed(name_links(names.select("cluster_id", "name")))
    settled = components(names.select("v"), links.select(mark("name_a").alias("a"), mark("name_b").alias("b")))
    joined = names.join(settled, "v")
    least = joined.groupBy("component").agg(F.min("first").alias("class_id"))
    ends = links.select("cluster_id", F.explode(F.array("name_a", "name_b")).alias("name")).groupBy("cluster_id", "name").agg(F.count("*").alias("spellings"))
    named = joined.join(least, "component").join(ends, ["cluster_id", "name"], "left").select("cluster_id", "name", "class_id", F.coalesce("spellings", F.lit(0)).alias("spellings"))
    return rows.join(named, ["cluster_id", "name"]).select("entity_pk", "class_id", "spellings")
