"""The trie search against plain edit distances; labels on a fixture."""

import random

import pytest

from skein.llm import canonical as c

TERMS = (("ORGANIZATION", ("institution",)), ("PERSON", ("human", "individual")), ("POLITICAL_PARTY", ("party organisation",)), ("VEHICLE", ("means of transport",)))
RELATIONS = (("BORN_IN", ("native of",)), ("FOUNDED_BY", ("set up by",)), ("LOCATED_IN", ("based in",)))


def matcher(entries, entity):
    """The resolved paths by brute force, as a trie."""
    every = [(path.replace(" ", ""), term, rank) for term, aliases in entries for path, rank in c.alias_paths(term, aliases, entity)]
    out = []
    for key in {k for k, _, _ in every}:
        least = min(r for k, _, r in every if k == key)
        owners = {t for k, t, r in every if k == key and r == least}
        out += [(key, (t, least, len(key))) for t in owners if least < 3 or len(owners) == 1]
    return out


def closest(value, entries, entity):
    found = c.candidates(value, c.Trie(matcher(entries, entity)))
    return found[0][2] if found else c.UNMATCHED


def distance(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("bound", [0, 1, 2, 3])
def test_search_is_exhaustive(bound):
    rng = random.Random(bound)
    keys = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(80)]
    trie = c.Trie((k, (k,)) for k in keys)
    for _ in range(60):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))
        assert sorted((d, p[0]) for d, p in trie.search(word, bound)) == sorted((distance(word, k), k) for k in keys if distance(word, k) <= bound)


@pytest.mark.parametrize(
    ("value", "term"),
    [
        ("perosns", "PERSON"), ("Type: Human", "PERSON"), ("label=human", "PERSON"), ("The Individual", "PERSON"), ("0rganizati0n", "ORGANIZATION"), ("KIND---institution [auto]", "ORGANIZATION"),
        ("politicalPprty", "POLITICAL_PARTY"), ("polit party", "POLITICAL_PARTY"), ("“vehcles” *", "VEHICLE"), ("wallpaper", "UNMATCHED"), ("n/a", "UNMATCHED"), ("x" * 50_000, "UNMATCHED"), ("???", "UNMATCHED"),
        ("Pérson", "PERSON"),
    ],
)
def test_values(value, term):
    assert closest(value, TERMS, True) == term


def test_relation_values():
    assert [closest(v, RELATIONS, False) for v in ("is founded by", "wasFoundedBy", "SET-UP-BY", "borm in", "sat opposite")] == ["FOUNDED_BY", "FOUNDED_BY", "FOUNDED_BY", "BORN_IN", "UNMATCHED"]


TERM = "field string, term string, aliases array<string>"


def test_operator(spark):
    rows = spark.createDataFrame([(1, "perosn", "v"), (1, "perosn", "v"), (2, "PERSON", "v"), (3, None, "v"), (4, " \t", "v"), (5, "zzz", "v"), (6, "", "v"), (None, "human", "v")], "entity_pk bigint, type string, value string")
    terms = spark.createDataFrame([("entity_type", "PERSON", ["human", None]), ("relation_type", "X", None), ("entity_type", None, None)], TERM)
    got = c.map_to_list(rows, "entity_pk", "type", terms, "entity_type")
    assert sorted((r.row_pk or 0, r.term) for r in got.collect()) == [(0, "PERSON"), (1, "PERSON"), (5, "UNMATCHED")]
    assert [tuple(r) for r in c.unmatched_report(got).collect()] == [("entity_type", "zzz", 1)]
    none = c.map_to_list(rows, "entity_pk", "type", terms.limit(0), "entity_type")
    assert {r.term for r in none.collect()} == {"UNMATCHED"}
    assert c.map_to_list(rows.limit(0), "entity_pk", "type", terms, "entity_type").count() == 0


def test_blocks_and_all_candidates(spark):
    """Paths as brute force resolves them; any size of the blocks gives the same candidates, and all of them."""
    terms = spark.createDataFrame([("relation_type", t, list(a)) for t, a in RELATIONS], TERM)
    paths = c.reference_paths(terms, "relation_type", {})
    assert {(r.key, (r.term, r.rank, r.size)) for r in paths.collect()} == set(matcher(RELATIONS, False))
    words = ["foundde by", "located", "born", "loacted at", "nativ of", "x", "funded by", "found in"]
    values = spark.createDataFrame([(w,) for w in words], "value string")
    whole = sorted(map(tuple, c.value_candidates(values, paths).collect()))
    assert whole == sorted(map(tuple, c.value_candidates(values, paths, 300).collect()))
    trie = c.Trie(matcher(RELATIONS, False))
    assert whole == sorted((w, t, d, r) for w in words for d, r, t in c.candidates(w, trie))


def test_gloss_and_word_forms():
    assert {"politician", "witness", "athlete", "human being"} <= set(c.gloss_paths("a named human being such as a politician, witness or athlete", True))
    assert {"animal", "plant"} <= set(c.gloss_paths("a kind of animal or plant", True))
    assert {"belongs to", "works with"} <= set(c.gloss_paths("the source belongs to or works with the target body", False))
    assert {"acquire", "acquiring", "acquisition"} <= set(c.verb_forms("acquired"))
    assert {"competitor", "competition", "competed"} <= set(c.verb_forms("competes"))
    assert c.gloss_paths("", True) == c.gloss_paths(" ", False) == []


def test_aliases_withheld():
    """Held-out recall: without its aliases, a term's inflections and derivations still come back."""
    entries = tuple((t, ()) for t in ("INVESTIGATED_BY", "ANNOUNCED", "NEGOTIATED_WITH", "PUBLISHED_BY", "ACQUIRED", "EMPLOYED_BY", "SUPPORTS", "EVACUATED_FROM"))
    forms = {"investigation by": 0, "investigating": 0, "announcement of": 1, "announces": 1, "negotiations with": 2, "negotiates": 2, "publication by": 3, "publisher": 3, "acquisition of": 4,
             "acquires": 4, "employee of": 5, "employment at": 5, "supporter of": 6, "supported": 6, "evacuation from": 7, "evacuates": 7}
    right = sum(closest(v, entries, False) == entries[k][0] for v, k in forms.items())
    assert right >= 15


def test_seeded_misspellings():
    """Held-out accuracy: terms with one random edit come back."""
    rng, right = random.Random(1), 0
    for _ in range(300):
        term = rng.choice(TERMS)[0]
        s, i = term.replace("_", " ").lower(), rng.randrange(1, len(term) - 1)
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + s[i] + s[i:], s[:i] + rng.choice("aeiost") + s[i + 1 :], s[: i - 1] + s[i] + s[i - 1] + s[i + 1 :]])
        right += closest(s, TERMS, True) == term
    assert right >= 297
