"""Pieces: limits, boundaries, exact round trip."""

import random

from pyspark.sql import functions as F

from skein.llm import splitting as s


def pieces(spark, texts, limit, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [[(p.text, p.fresh_from, p.repeated) for p in r.p] if r.p is not None else None for r in df.select("i", s.split_text(F.col("text"), limit, overlap).alias("p")).orderBy("i").collect()]


def test_round_trip(spark):
    rng = random.Random(9)
    words = ["alpha", "bé", "👨‍🌾", "gamma,", "delta.", "end!", "\n\n", "\n", "x" * 70, "é" * 9, "  "]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(0, 120))) for _ in range(60)] + ["y" * 1000, "", " " * 500, None]
    for limit, overlap in ((100, 20), (64, 0), (50, 49), (3, 1)):
        for text, got in zip(texts, pieces(spark, texts, limit, overlap), strict=True):
            if text is None:
                assert got is None
                continue
            assert "".join(p[r:] for p, _, r in got) == text
            at = 0
            for k, (p, start, r) in enumerate(got):
                assert len(p) <= limit and start == at and r <= overlap
                assert p[:r] == text[start - r : start] and (k > 0 or r == 0) and len(p) > r
                at += len(p) - r
            assert len(got) <= 1 or len(text) > limit


def test_boundaries(spark):
    text = ("One two three. " * 6 + "\n\n" + "Four five six seven eight nine. " * 20).strip()
    got = pieces(spark, [text], 120, 20)[0]
    assert got[0][0].endswith("\n\n") and all(p.rstrip().endswith(".") for p, _, _ in got)
    assert all(r == 0 or p[0].isupper() or not p[0].isspace() for p, _, r in got)
    assert pieces(spark, ["word " + "z" * 300], 100, 10)[0][0][0] == "word "
    accents = "é" * 200
    assert not any(p[0] == "́" for p, _, _ in pieces(spark, [accents], 99, 0)[0])


def test_members(spark):
    long = "Sentence here. " * 300
    df = spark.createDataFrame([(1, f" a|||||\n|||||{long}|||||", "t"), (2, None, "t"), (3, "|||||", "t"), (4, "x" * 3000 + "|||||" + "y" * 3001, "t"), (5, "　\x1c|||||b", "t")], "row_id bigint, document string, text string")
    m = {(r.row_id, r.document_index): r.text for r in s.cluster_members(df).collect()}
    assert m[1, 0] == "a" and m[1, 1] == long.strip() and set(m) == {(1, 0), (1, 1), (4, 0), (4, 1), (5, 0)}
    cut = s.member_pieces(df, only_split=True)
    assert {(r.row_id, r.document_index) for r in cut.where("piece = 1").collect()} == {(1, 1), (4, 1)}
    assert cut.agg(F.max(F.length("text"))).first()[0] <= 3000
    assert s.member_pieces(df.limit(0)).count() == 0
