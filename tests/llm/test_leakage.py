"""Leaks planted in texts, against a brute-force alignment."""

import random

import numpy as np

from skein.llm import leakage as k

RNG = random.Random(12)
VOCAB = ["".join(RNG.choice(["ba", "ko", "ru", "ti", "gre"]) for _ in range(3)) for _ in range(400)]
OPENING = "Read the report below and answer with a single name"


def text(n, rng):
    return [rng.choice(VOCAB) for _ in range(n)]


def test_planted(spark):
    rng = random.Random(3)
    items = [(i, "qa", OPENING + ". " + " ".join(text(60, rng)), "a") for i in range(5)]
    body = lambda i: items[i][2].split()[10:]
    swapped = [w if j % 11 else "changed" for j, w in enumerate(body(1))]
    docs = [
        (1, " ".join(text(50, rng) + body(0) + text(50, rng))), (2, "<p>" + " ".join(swapped).upper().replace(" ", ",\n<b>", 5) + "</p>"),
        (3, " ".join(text(40, rng) + body(2)[:12] + text(20, rng) + body(2)[30:48] + text(9, rng))), (4, " ".join(body(3)[:15])), (5, " ".join(body(4)[40:] + text(30, rng) + body(4)[:20])),
        (6, OPENING + " " + " ".join(text(80, rng))), (7, None), (8, ""), (None, " ".join(body(0))), (9, " ".join(text(200_000, rng) + body(0))), (1, " ".join(text(50, rng) + body(0) + text(50, rng))),
    ]
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id bigint, text string, item_id int")
    e = spark.createDataFrame([*items, (99, "qa", None, None), (98, "qa", "", None), (None, "qa", "x " * 9, None)], "item_id bigint, suite string, text string, answer string")
    leaks = k.leaked_items(d, e)
    assert {(r.item_id, r.doc_id) for r in leaks.collect()} == {(0, 1), (1, 2), (2, 3), (0, 9)}
    assert k.decontaminated(d.where("doc_id < 5"), leaks).count() == 1
    assert {r.item_id: r.documents for r in k.item_report(leaks).collect()} == {0: 2, 1: 1, 2: 1}
    assert k.leaked_items(d.limit(0), e).count() == 0
    assert k.leaked_items(d, e.limit(0)).count() == 0


def pairs(rows):
    return {(r.item_id, r.doc_id) for r in rows.collect()}


ITEM = "item_id bigint, suite string, text string, answer string"


def test_blocks_agree(spark):
    """The instruction line is found whatever the blocks are: two items a block give what one block gives."""
    rng = random.Random(4)
    items = [(i, "s", OPENING + " " + " ".join(text(20, rng)), None) for i in range(6)]
    d = spark.createDataFrame([(i, items[i][2]) for i in range(6)] + [(9, OPENING + " " + " ".join(text(50, rng)))], "doc_id bigint, text string")
    e = spark.createDataFrame(items, ITEM)
    blocks = list(k.item_blocks(e, 70))
    assert len(blocks) == 3 and sum(map(len, blocks)) == 6
    whole = k.leaked_items(d, e).collect()
    assert {(r.item_id, r.doc_id) for r in whole} == {(i, i) for i in range(6)}
    assert sorted(map(tuple, whole)) == sorted(map(tuple, k.leaked_items(d, e, block_words=70).collect()))


def test_long_instructions_and_short_items(spark):
    rng = random.Random(14)
    opening = text(90, rng)
    e = spark.createDataFrame([(i, "s", " ".join(opening + text(95, rng)), None) for i in range(4)] + [(9, "t", "Who built Tavo pier?", None), (10, "t", "Tavo pier", None)], ITEM)
    d = spark.createDataFrame([(1, " ".join(opening)), (2, "I ask: who BUILT Tavo pier, and when?"), (3, "who built the Tavo pier, ferry and Tavo pier")], "doc_id bigint, text string")
    assert pairs(k.leaked_items(d, e)) == {(9, 2)}


def test_exchanged_words_against_all_alignments():
    """Passages of a third or more with a word exchanged every four to ten: what laying the item along every diagonal
    finds, the seeds find."""
    rng = random.Random(15)
    least = 1 / 3
    lost = found = 0
    for trial in range(150):
        item = text(rng.randrange(30, 150), rng)
        part = item[(at := rng.randrange(0, len(item) // 2)) : at + rng.randrange(len(item) // 3, len(item))]
        gap, doc = rng.randrange(4, 11), []
        for j, w in enumerate(part):
            doc.append("changed" if j % gap == gap - 1 else w)
        doc = text(rng.randrange(40), rng) + doc + text(rng.randrange(40), rng)
        index = k.ItemIndex([(1, item, 0)])
        ids = np.array([index.vocab.get(w, 0) for w in doc])
        every = index.runs(ids, 0, np.arange(-len(item), len(doc)))
        want = index.chain(every)[0] / len(item) >= least
        got = bool(index.search([doc], least))
        assert got == want, trial
        kept = sum(w != "changed" for w in doc[: len(doc)]) and sum(1 for j in range(len(part)) if j % gap != gap - 1) / len(item) >= least
        found, lost = found + (kept and got), lost + (kept and not got)
    assert lost <= 0.03 * (found + lost)


def test_tags_of_any_length():
    long = "<a href='" + "x" * 2000 + "' title=\"" + "word " * 200 + "\">"
    assert k.tokens(f"one {long}two</a> <b>three</b> a<b and c>d".replace("a<b and c>d", "four < five")) == ["one", "two", "three", "four", "five"]
    assert k.tokens("caf&eacute; so\u00adft &amp; x&#233;y") == ["café", "soft", "xéy"]


def test_spans_are_removed(spark):
    rng = random.Random(16)
    item = text(60, rng)
    half = ["caf&eacute;", *item[:20], "<b>" + item[20] + "</b>", *item[21:40]]
    e = spark.createDataFrame([(1, "s", " ".join(item), None)], ITEM)
    d = spark.createDataFrame([(1, "Before this. " + ", ".join(half) + ". After that."), (2, "clean"), (3, None)], "doc_id bigint, text string")
    leaks = k.leaked_items(d, e)
    out = {r.doc_id: r.text for r in k.without_passages(d, leaks).collect()}
    assert out[2] == "clean" and out[3] is None
    assert k.tokens(out[1]) == ["before", "this", "café", "after", "that"]
    assert k.leaked_items(k.without_passages(d, leaks), e).count() == 0


def test_token_places():
    rng = random.Random(17)
    for _ in range(200):
        t = "".join(rng.choice(["ab", "é", "&amp;", "&eacute;", "&", "<b>", "</i>", " ", "\u00ad", "X", "&#x41;", "<", ".", "İ", "4"]) for _ in range(30))
        places = k.token_places(t)
        assert len(places) == len(k.tokens(t.replace("İ", "i")))
        assert all(a < b for a, b in places) and all(x[1] <= y[0] for x, y in zip(places, places[1:], strict=False))


def test_chain_against_exhaustive():
    rng = random.Random(5)
    for _ in range(60):
        runs = []
        for _ in range(rng.randrange(1, 6)):
            a, d, m = rng.randrange(60), rng.randrange(60), rng.randrange(8, 14)
            runs.append((a, a + m, d, m))
        best = 0
        for mask in range(1 << len(runs)):
            way = sorted(r for i, r in enumerate(runs) if mask >> i & 1)
            total, ok = 0, True
            for i, (a, b, d, m) in enumerate(way):
                over = 0
                if i:
                    a2, b2, d2, _ = way[i - 1]
                    over = max(0, b2 - a, d2 + (b2 - a2) - d)
                    ok &= a2 < a and d2 < d and over < min(m, b2 - a2)
                total += m - over
            best = max(best, total if ok else 0)
        assert k.ItemIndex.chain(runs)[0] == best


def test_seeds_are_all_hits():
    rng = random.Random(6)
    items = [(i, "", text(30, rng)) for i in range(4)]
    index = k.ItemIndex([(i, own, 0) for i, _, own in items])
    words = text(30, rng) + items[2][2][5:20] + text(10, rng)
    ids = np.array([index.vocab.get(w, 0) for w in words])
    at, item, pos = index.lookup(ids)
    want = {(x, i, y) for i, (_, _, own) in enumerate(items) for x in range(len(words) - k.GRAM + 1) for y in range(len(own) - k.GRAM + 1) if words[x : x + k.GRAM] == own[y : y + k.GRAM]}
    assert set(zip(at.tolist(), item.tolist(), pos.tolist(), strict=True)) == want


def test_repeated_items_and_shared_passages(spark):
    """An item delivered or listed three times, and three questions over one passage, keep their openings."""
    rng = random.Random(7)
    once, passage = text(50, rng), text(45, rng)
    rows = [(1, "qa", " ".join(once), None)] * 3 + [(k, "qa", " ".join(once), None) for k in (2, 3)]
    rows += [(k, "qa", " ".join(passage) + "\n" + " ".join(text(8, rng)), None) for k in (4, 5, 6)] + [(k, "qa", " ".join(text(60, rng)), None) for k in range(7, 16)]
    e = spark.createDataFrame(rows, "item_id bigint, suite string, text string, answer string")
    d = spark.createDataFrame([(1, " ".join(text(30, rng) + once + text(30, rng))), (2, " ".join(text(30, rng) + passage + text(30, rng)))], "doc_id bigint, text string")
    assert {(r.item_id, r.doc_id) for r in k.leaked_items(d, e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2)}


def openings(items, least=3):
    """Brute force: item -> words of the instruction line."""
    texts = {(suite, tuple(words)): line for _, suite, words, line in items}
    out = {}
    for item, suite, words, _ in items:
        own = [(w, line) for (s, w), line in texts.items() if s == suite]
        common = by_line = 0
        for n in range(1, len(words) + 1):
            alike = [(w, line) for w, line in own if w[:n] == tuple(words[:n])]
            roomy = 2 * sum(2 * n <= len(w) for w, _ in alike) >= len(alike)
            if len(alike) >= max(least, len(own) / 2):
                common = n if roomy else 0
            if sum(line == n for _, line in alike) >= least and roomy:
                by_line = n
        out[item] = min(max(common, by_line), out.get(item, len(words)))
    return out


def test_instruction_lines(spark):
    rng = random.Random(8)
    first, second = OPENING.lower().split(), "now fill in the word that is missing".split()
    items = [(i, "a", first + text(40, rng), 0) for i in range(6)] + [(9, "a", text(40, rng), 0)]
    items += [(20 + i, "b", second + text(40, rng), len(second)) for i in range(3)] + [(30 + i, "b", text(40, rng), 0) for i in range(9)]
    items += [(40 + i, rng.choice("cde"), (same := text(3, random.Random(1))) + text(rng.randrange(1, 6), rng), rng.choice([0, 3])) for i in range(40)]
    rows = [(i, s, " ".join(w[:line]) + "\n" * bool(line) + " ".join(w[line:]), None) for i, s, w, line in items]
    got = {r.item_id: r.skip for r in k.instruction_words(spark.createDataFrame(rows + rows[:4], ITEM)).collect()}
    assert got == openings(items)
    assert got[0] == len(first) and got[20] == len(second) and got[9] == got[30] == 0 and len(same) == 3
