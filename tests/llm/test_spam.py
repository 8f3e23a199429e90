"""Junk pages on labelled fixtures; the trees by held-out accuracy."""

import numpy as np
import pytest

from skein.llm import spam

ARTICLE = (
    "Harbor to reopen ferry by May\n\nThe mayor of Tavo called the beam late and urged the council to mend it before winter. Workers at the yard were told to count every plank by hand. "
    "A spokesperson declined to say whether the money had been found, though the bridge remains closed to lorries.\n\nTwo residents signed a letter that asks for a new crossing."
)
JUNK = {
    "links": "\n".join(f"- Item {k} https://a{k}.example/p?id={k}" for k in range(20)), "anchors": "".join(f'<a href="https://x.test/{k}">page {k}</a>' for k in range(20)),
    "menu": "Home > Login > Cart mill > Terms > Print > Share\n" + "\n".join(f"Cabinet ({k})" for k in range(20)), "tags": " ".join(f"#tag{k}" for k in range(40)), "slashes": " / ".join(f"word{chr(97 + k)} mill" for k in range(20)),
    "semicolons": "Filed under: " + "; ".join(f"old word{chr(97 + k)}" for k in range(20)), "products": "\n".join(f"Red mug A{k} | 12 cm | EUR {k}.50 | new" for k in range(20)), "lines": "\n".join(f"{w} repair Town{chr(97 + k)}" for k, w in enumerate(["helmet", "lamp", "boots"] * 9)),
    "sentences": " ".join(f"Order {w} lamp lamp deals, lamp shop for lamp offers and the top lamp seller." for w in ["blue", "used", "small", "brass", "floor", "desk", "round", "glass"]),
    "heap": "buy boots cheap boots online lamp store lamp sale boots outlet lamp price boots review lamp best boots order lamp shipping boots new lamp",
}
FINE = {
    "article": ARTICLE, "with links": ARTICLE + "\nRelated links:\nhttps://a.example/1\nhttps://b.example/2", "with list": ARTICLE + "\n- Ann Kolv, pilot\n- 52 beams blocked\n- old mill at Tavo",
    "nouns of a refrain": ARTICLE + "\n" + " ".join(f"The scooter that the {w} left is a red scooter, and the owner of that scooter wants it back." for w in ["judge", "nurse", "pilot", "miner", "clerk", "guard", "baker", "usher"]),
    "names": " ".join(f"{a} by Tavo Bridge Board said that the {b} of Tavo would cost more than Tavo had paid for it." for a, b in zip(["A report", "A letter", "A note", "A book"], ["dam", "pier", "quay", "lock"])),
    "refrain": ARTICLE + "\n" + "And the river runs on to the sea tonight.\n" * 30, "encoded": ARTICLE + "\n" + "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 200, "underscores": ARTICLE + "\n" + "_" * 5000,
}


@pytest.mark.parametrize("name", list(JUNK))
def test_junk(name):
    assert spam.page_features(JUNK[name])[5] > 0.5
    assert spam.page_features(JUNK[name] + "\n" + ARTICLE * 8)[5] < 0.5


@pytest.mark.parametrize("name", list(FINE))
def test_fine(name):
    assert spam.page_features(FINE[name])[5] < 0.5


def test_operator(spark):
    rows = [(k, f"h{k % 3}", t, 0.1) for k, t in enumerate([*JUNK.values(), *FINE.values()] * 6)]
    rows += [(900, None, JUNK["links"], 0.1), (901, None, None, 0.1), (902, "h1", "", 0.1), (None, "h1", JUNK["tags"], 0.1), (0, "h0", rows[0][2], 0.1), (903, "h1", ARTICLE * 3000, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, junk double")
    n = len(JUNK) + len(FINE)
    assert {r.doc_id for r in spam.spam_pages(docs).collect()} == {k for k in range(6 * n) if k % n < len(JUNK)} | {900}
    assert {r.source for r in spam.host_report(docs).collect()} == {"h0", "h1", "h2", None}


def test_one_label_or_none(spark):
    schema = "doc_id bigint, source string, text string"
    assert spam.spam_pages(spark.createDataFrame([], schema)).count() == 0
    assert spam.spam_pages(spark.createDataFrame([(1, "a", JUNK["tags"])], schema)).count() == 1
    assert spam.spam_pages(spark.createDataFrame([(1, "a", ARTICLE)], schema)).count() == 0


def test_trees_held_out():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3) | (x[:, 2] > 0.9)).astype(float)
    model = spam.BaggedTrees(9, 6).fit(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.97
    assert spam.BaggedTrees().fit(x[:50] * 0, y[:50]).predict(x[:3]).shape == (3,)


def test_admits_what_the_count_misses(spark):
    """A list of tags, one a line and none twice, is no junk to the count; the votes admit it. Articles stay out."""
    rng = np.random.default_rng(4)
    tags = lambda: "\n".join("".join(rng.choice(["ba", "ko", "ru", "ti", "gre", "su"], 3)) + " " + "".join(rng.choice(["mol", "ten", "vi", "da"], 3)) for _ in range(40))
    pages = [tags() for _ in range(4)]
    assert all(spam.page_features(t)[5] <= 0.5 for t in pages)
    rows = [(k, f"h{k % 3}", t) for k, t in enumerate([*JUNK.values(), *FINE.values()] * 6)] + [(500 + k, "h1", t) for k, t in enumerate(pages)]
    got = {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    n = len(JUNK) + len(FINE)
    assert got == {k for k in range(6 * n) if k % n < len(JUNK)} | {500, 501, 502, 503}


def test_host_can_decide(spark):
    """No vote is so sure that the rate of its host can't bring it over the bound of suspicion."""
    prose = [ARTICLE + f"\nIt was said on day {k} that the ferry of the town would be late for the market." for k in range(600)]
    rows = [(1000 + k, "clean", t) for k, t in enumerate(prose)] + [(100 + k, "bad", JUNK["links"]) for k in range(200)] + [(400, "bad", prose[0])]
    pages = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    p = {r.doc_id: r.p for r in spam.score_pages(pages, 1.0).collect()}
    assert p[400] > spam.DECIDE > p[1000]
    assert 400 not in {r.doc_id for r in spam.spam_pages(pages).collect()}  # the count does not confirm it
