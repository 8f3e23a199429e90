"""Links of name variants on labelled fixtures, and against all pairs."""

import itertools
import random

import pytest

from skein.llm import names as n

ENT = "entity_pk bigint, cluster_id string, name string, type string"
SAME = [
    ["Nicholas Gubajobix", "GUBAJOBIX, N.", "N. Gubajobix", "Nick Gubajobix", "Gubajobix, Nicholas", "Dr. Nicholas R. Gubajobix", "Nicholas Gubajoibx", " nicholas gubajobix", "Judge Gubajobix"],
    ["Jefamugate Football Federation", "JFF", "J.F.F.", "Jefamugate Football Fed.", "Football Federation of Jefamugate", "Football Federation, Jefamugate", "jefamugate-football-federation",
     "The Jefamugate Football Federation", "Jefamugate Football Federation (JFF)", "Jefamugate Footbal Federation", "JEFAMUGATE FOOTBALL FEDERATION"],
    ["Jefamugate Teachers Association", "Jefamugate Teachers Assn"], ["Samantha Zogokragax", "Sam Zogokragax"], ["Yolanda Zogokragax", "Y. Zogokragax", "Yolanda Zogokrágax"], ["Tavobustad"], ["Urgent Depot Week"],
    ["Vumido Insurance Brothers and Company", "Vumido Insurance Bros. & Co."],
]


def rows(groups, cluster="c", start=0):
    return [(start + k, cluster, name, None) for k, name in enumerate(itertools.chain(*groups))]


def found(spark, data):
    return {tuple(r) for r in n.linked_rows(spark.createDataFrame(data, ENT)).collect()}


def expected(groups):
    at, out = 0, set()
    for g in groups:
        out |= {(at + i, at + j) for i, j in itertools.combinations(range(len(g)), 2) if g[i] != g[j]}
        at += len(g)
    return out


def test_fixture(spark):
    assert found(spark, rows(SAME)) == expected(SAME)


def test_clusters_repeats_and_nulls(spark):
    data = [(1, "a", "Ann Bexley", "x"), (1, "a", "Ann Bexley", "x"), (2, "b", "A. Bexley", "x"), (3, "a", None, "x"), (4, None, "Ann Bexley", "x"), (5, "a", "", "x"), (6, "a", "Robert Kolvandik", "x"),
            (7, "a", "Bob Kolvandik", "x"), (8, "a", "Robert Kolvandik", "x"), (9, "a", "…", "x"), (10, "a", "x" * 20_000, "x"), (11, "a", ",", "x"), (12, "a", ", Bob", "x")]
    assert found(spark, data) == {(6, 7), (7, 8)}
    assert found(spark, []) == set()


def test_ambiguous_short_forms(spark):
    """A family name or initial of two relatives names neither."""
    data = rows([["Robert Kolvandik", "Richard Kolvandik", "R. Kolvandik", "Judge Kolvandik", "Bob Kolvandik"]])
    assert found(spark, data) == {(0, 4)}
    assert found(spark, rows([["Robert Kolvandik", "Samuel Kolvandik", "R. Kolvandik"]])) == {(0, 2)}


def test_acronym_of_two_bodies(spark):
    assert found(spark, rows([["Jabo Football Federation", "Jiku Food Foundation", "JFF"]])) == set()


def test_two_misspellings_over_the_right_one(spark):
    assert found(spark, rows([["Nicholas Gubajobix", "Nicholas Gbajobix", "Nicholas Gubajbix"]])) == {(0, 1), (0, 2), (1, 2)}


def test_against_all_pairs(spark):
    """Full names: the equi-join on forms finds what comparing all pairs finds, up to one step in between."""
    rng = random.Random(6)
    base = ["".join(rng.choice(["ba", "ko", "ru", "ti", "gre", "su"]) for _ in range(4)) + "x" for _ in range(12)]
    data = []
    for k in range(60):
        s, i = rng.choice(base), rng.randrange(1, 6)
        s = rng.choice([s, s, s[:i] + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :]])
        data.append((k, "c", f"{rng.choice(['Robert', 'Bob', 'Ursula'])} {s.title()}", None))
    direct = {(a[0], b[0]) for a, b in itertools.combinations(data, 2) if a[2] != b[2] and n.compatible(a[2], b[2]) and n.within(n.parse(a[2]).own, n.parse(b[2]).own, 1)}
    got = found(spark, data)
    assert direct <= got
    for a, b in got:
        x, y = n.parse(data[a][2]), n.parse(data[b][2])
        assert x.given & y.given and n.within(x.own, y.own, 4)


@pytest.mark.parametrize(("a", "b", "bound", "same"), [("abc", "acb", 1, True), ("abc", "abcd", 1, True), ("abc", "axyc", 1, False), ("", "a", 1, True), ("", "", 0, True), ("abcd", "badc", 2, True)])
def test_within(a, b, bound, same):
    assert n.within(a, b, bound) is same


def test_spellings_report(spark):
    out = {r.name: r.spellings for r in n.variant_report(spark.createDataFrame(rows(SAME[2:3]), ENT)).collect()}
    assert out == {"Jefamugate Teachers Association": 1, "Jefamugate Teachers Assn": 1}


def test_two_misspellings_without_the_right_one(spark):
    """Bases that no row bears: the misspellings share the beginning or the end."""
    data = rows([["Dasekkrahaven Farmers Cooperative", "Daserahaven Farmers Cooperative"], ["Greg Pajuusogralt", "Gregory Pajusoralt"]])
    assert found(spark, data) == {(0, 1), (2, 3)}


UNLISTED = [
    ["Aisha Rahman", "AISHA RAHMAN", "Rahman, Aisha", "aisha  rahman", "Dr. Aisha Rahman", "A. Rahman", "Aisha Rahmann"], ["Mary Jane Watson", "WATSON, Mary Jane", "mary jane watson"], ["Jan van Dijk", "van Dijk, Jan", "JAN VAN DIJK"],
    ["Acme Corp", "ACME Corp.", "Acme Corporation"], ["Bank of Sorvia", "The Bank of Sorvia", "BANK OF SORVIA"], ["Reuters", "REUTERS", "reuters "], ["Apollo 11", "APOLLO 11"], ["Apollo 12"], ["Aisha Kolv"], ["Frozen Plaza"], ["Plaza"],
]


def test_names_outside_the_lists(spark):
    assert found(spark, rows(UNLISTED)) == expected(UNLISTED)
    assert all(n.forms(name).own or n.forms(name).whole for g in UNLISTED for name in g)
    assert n.forms(",").whole and n.forms("…").whole and not n.forms("  ").whole


def test_case_of_an_ambiguous_family_name(spark):
    data = rows([["Robert Kolvandik", "Richard Kolvandik", "Kolvandik", "KOLVANDIK"]])
    assert found(spark, data) == {(2, 3)}


def test_held_out_names(spark):
    """Names made for no list: linked, or refused for the reason given."""
    linked = [["Siobhan Delacroix", "S. Delacroix"], ["Wei Zhang", "W. Zhang"], ["Priya Ramanathan", "Priya Ramanthan"], ["Siemens AG", "Siemens Aktiengesellschaft"], ["Acme GmbH", "Acme"], ["Tesla, Inc.", "Tesla Inc"],
              ["Abigail Bonnet", "Abby Bonnet"], ["Warner Ingrid", "Ingrid Warner"], ["Global Widgets LLC", "Global Widgets"], ["Q" + "abcdefgh" * 9 + " Institute of Food", "Q" + "abcdefgh" * 4 + "x" + "abcdefgh" * 5 + " Institute of Food"]]
    refused = [
        ["Maria del Carmen Lopez", "Maria Lopez"],  # a middle name written out may tell two relatives apart
        ["Lee Ann", "Leo Ann"],  # tokens of up to four letters must agree
    ]
    assert found(spark, rows([*linked, *refused])) == expected(linked)


def test_rewriting_scores(spark):
    """An initial scores one over the persons that it may mean; a lower bound lets the ambiguous one pass."""
    names = spark.createDataFrame([("c", x) for x in ("Robert Kolvandik", "Richard Kolvandik", "R. Kolvandik")], "cluster_id string, name string")
    assert n.name_links(names).count() == 0
    assert {(r.name_a, r.name_b) for r in n.name_links(names, 0.4).collect()} >= {("R. Kolvandik", "Robert Kolvandik"), ("R. Kolvandik", "Richard Kolvandik")}


def test_namesakes_cost_no_pairs(spark):
    """Of hundreds of bearers of one family name, only those of one given name are compared."""
    given = ["".join(p) for p in itertools.product(["Bar", "Dor", "Fel", "Gus", "Hen"], ["a", "bert", "dina", "iko"], ["", "l", "s"])]
    names = spark.createDataFrame([("c", f"{g} Kolvandik") for g in given] + [("c", f"{g} kolvandik") for g in given], "cluster_id string, name string")
    assert n.name_pairs(names).count() == 2 * len(given)
    assert n.name_links(names).count() == len(given)


def test_classes(spark):
    """Classes by membership: all spellings of one entity share the least key; repeated rows and copies are members once."""
    groups = [SAME[0], SAME[3], SAME[5]]
    data = rows(groups, start=5)
    data += [(100, "c", groups[0][0], None), (100, "c", groups[0][0], None), (101, "d", groups[0][0], None), (102, "c", None, None), (None, "c", "Tavobustad", None)]
    got = {r.entity_pk: (r.class_id, r.spellings) for r in n.variant_classes(spark.createDataFrame(data, ENT)).collect()}
    want, at = {101: (101, 0)}, 5
    for g in groups:
        want |= {at + k: (at, len(g) - 1) for k in range(len(g))}
        at += len(g)
    want[100] = want[5]
    assert got == want
    assert n.variant_classes(spark.createDataFrame([], ENT)).count() == 0
