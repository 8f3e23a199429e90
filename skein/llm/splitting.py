"""Splitting oversized items at natural boundaries, with overlap.

Method: bounded-quantifier regex extraction. One regex, run inside the JVM over the whole text, consumes up to the
limit; its alternatives are ordered by boundary strength (whole rest, paragraph, sentence, line, word, character) and
each is greedy, so the longest chunk ending at the strongest boundary in reach is taken. The overlap is a lookback
into the piece before, found by array functions and cut at a sentence or word start. Lengths are Unicode code points:
Java's ``.`` and Spark's ``length`` both count those. No Python, no shuffle: a text's pieces come out of its own row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import strip_ws

SEPARATOR = r"\|{5}"
def chunk_pattern(limit: int, least: float = 0.5) -> str:
    """The regex whose successive matches are the chunks of a text. ``least`` of the limit must be filled before a weaker
    boundary is given up for; alternatives are tried from the strongest boundary to the bare character."""
    low = max(1, int(limit * least))
    reach = f"{{{low},{limit}}}"
    boundaries = [r"(?<=\n[ \t\r]?\n)", r"(?<=[.!?…。][\"'”’)\]]?\s)", r"(?<=\n)", r"(?<=\s)"]
    early = [rf".{{0,{limit - 2}}}\S\s"] if limit > 2 else []  # a boundary before the least filling is still one
    whole = rf".{{1,{limit}}}(?![\p{{M}}\u200d\ufe0f])"  # no cut between a letter and its marks
    return "(?s)" + "|".join([rf".{{1,{limit}}}\z", *[f".{reach}{b}" for b in boundaries], *early, whole, f".{{1,{limit}}}"])


def split_text(text: Column, limit: int = 3000, overlap: int = 200) -> Column:
    """array<struct<text, fresh_from>> of the pieces of a text: each at most ``limit`` code points, each but the first
    opening with up to ``overlap`` repeated from the end of the one before; ``fresh_from`` is the 0-based offset in the
    source at which the piece's new text begins, so that substr(piece, repeated) over all pieces gives the source back.

    A text within the limit is one piece; an empty one gives no piece, null gives null."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    body = limit - overlap
    chunks = F.when(F.length(text) <= limit, F.filter(F.array(text), lambda x: x != "")).otherwise(F.regexp_extract_all(text, F.lit(chunk_pattern(body)), 0))

    def piece(chunk: Column, start: Column) -> Column:
        size = F.least(F.lit(overlap), start)
        return _let(F.substring(text, start - size + 1, size), lambda back: _let(_repeated(back, start), lambda r: F.struct(F.concat(r, chunk).alias("text"), start.alias("fresh_from"), F.length(r).alias("repeated"))))

    def pieces(cut: Column) -> Column:
        starts = F.aggregate(cut, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
        return _let(starts, lambda at: F.transform(cut, lambda chunk, i: piece(chunk, F.get(at, i))))

    return _let(chunks, pieces)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once: a lambda would compute it anew wherever it names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated(back: Column, start: Column) -> Column:
    """The lookback without the word that its window cuts, from the first sentence start in it if there is one."""
    sentence = F.regexp_extract(back, r"(?s)[.!?\n][\"'”’)\]]?\s+(\S.*)\z", 1)
    word = F.regexp_extract(back, r"(?s)\s(\S.*)\z", 1)
    return F.when(start == 0, "").otherwise(F.coalesce(F.nullif(sentence, F.lit("")), F.nullif(word, F.lit("")), back))


def cluster_members(clusters: DataFrame) -> DataFrame:
    """(row_id, document_index, text): members of ``clusters.document`` between separators, stripped, blank ones
    dropped before numbering. A null document has no members."""
    parts = F.filter(F.transform(F.split("document", SEPARATOR), strip_ws), lambda x: x != "")
    return clusters.select("row_id", F.posexplode(parts).alias("document_index", "text"))


def member_pieces(clusters: DataFrame, limit: int = 3000, overlap: int = 200, only_split: bool = False) -> DataFrame:
    """(row_id, document_index, piece, text, fresh_from, repeated): the pieces of all members, or only of those longer
    than the limit. Rows delivered twice give their pieces twice; row_id is unique in the table."""
    members = cluster_members(clusters)
    if only_split:
        members = members.where(F.length("text") > limit)
    pieces = members.select("row_id", "document_index", F.posexplode(split_text(F.col("text"), limit, overlap)).alias("piece", "p"))
    return pieces.select("row_id", "document_index", "piece", "p.text", "p.fresh_from", "p.repeated")
