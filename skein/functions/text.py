"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip takes it.
WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SEPARATOR = r"\|{5}"


def strip_ws(c: Column) -> Column:
    """Without surrounding white space of any kind (Spark's trim takes blanks only)."""
    return F.btrim(c, F.lit(WS))


def strip_fences(c: Column) -> Column:
    """Without one leading code fence (with or without the word json) and one trailing fence, then stripped."""
    body = F.regexp_replace(strip_ws(c), r"^```(?:json)?", "")
    return strip_ws(F.regexp_replace(body, r"```\z", ""))


def fenced_block(c: Column) -> Column:
    """The inside of the first fenced block, wherever it stands; without a fence the stripped text itself."""
    after_json = F.try_element_at(F.split(c, "```json", 2), F.lit(2))
    after_any = F.try_element_at(F.split(c, "```", 2), F.lit(2))
    inside = F.coalesce(after_json, after_any)
    return strip_ws(F.when(inside.isNull(), c).otherwise(F.element_at(F.split(inside, "```", 2), 1)))


def members(document: Column) -> Column:
    """The documents of a cluster text: cut at the separator, stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(document, SEPARATOR), strip_ws), lambda x: x != "")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def alias_key(c: Column) -> Column:
    """The spelling-independent key of a name: letters and digits in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
