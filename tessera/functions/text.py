"""Text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
BLANK = r"[ \t\n\x0B\f\r]+"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK, " "))


def normalized(text: Column) -> Column:
    """Straight quotes and hyphens, single spaces."""
    quotes = F.translate(text, "‘’`´“”‐‑‒–—", "''''\"\"-----")
    return collapse(quotes)


def _accents() -> tuple[str, str]:
    import unicodedata

    pairs = []
    for code in range(0xC0, 0x1F00):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code) and (code < 0x250 or 0x1E00 <= code):
            pairs.append((chr(code), base))
    pairs += [("đ", "d"), ("Đ", "D")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def unaccented(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}", "")


def search_text(text: Column) -> Column:
    """Without accents and case; what isn't a letter, digit, underscore or hyphen becomes a space."""
    folded = F.replace(F.lower(unaccented(normalized(text))), F.lit("ß"), F.lit("ss"))
    return collapse(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s-]", " "))


def terms(text: Column) -> Column:
    """Words of a text in search form."""
    return F.filter(F.split(search_text(text), " "), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def windowed(df: DataFrame, keys: list[str], text: str, size: int = 300, overlap: int = 40) -> DataFrame:
    """keys, i and ws: arrays of `size` words; the next begins `overlap` words before the last ends; no window of overlap only.

    A text is split once, in a projection of its own, and its windows are slices of that.
    """
    df = df.select(*keys, words(F.col(text)).alias("_w"))
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.greatest(F.size("_w") - overlap - 1, F.lit(0)), F.lit(size - overlap)))
    cut = df.select(*keys, F.posexplode_outer(F.transform(starts, lambda s: F.slice("_w", s + 1, size))).alias("i", "ws"))
    return cut.where("ws is not null").withColumn("i", F.col("i").cast("long"))


def token_tail(text: Column, n: int = 60) -> Column:
    """The text from its n-th last token on. Read backwards, tokens are the same runs, so the tail is a beginning."""
    behind = F.regexp_extract(F.reverse(text), rf"^\s*(?:(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s])\s*){{0,{n}}}", 0)
    return F.regexp_replace(F.reverse(behind), r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode normal form C, for which Spark has no function."""
    return text.str.normalize("NFC")


NUMBER = r"(?<![\p{L}\p{N}_])(-?[0-9]+(?:[.,][0-9]+)?%?)"


def numbers(text: Column) -> Column:
    """Signed decimals with their percent sign, a comma as a point."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")))


def citations(text: Column) -> Column:
    """All ids cited as [S1], in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(r"\[(S[1-9][0-9]*)\]"), F.lit(1))


def lexical_query(terms: Column) -> Column:
    """Terms joined by OR, those of several words quoted, without characters of the query syntax, each once."""
    safe = F.filter(F.transform(terms, lambda x: collapse(F.regexp_replace(normalized(x), r"[^\p{L}\p{N}_\s'-]", " "))), lambda x: x != "")
    quoted = F.transform(safe, lambda x: F.when(x.contains(" "), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x))
    return F.array_join(F.array_distinct(quoted), " OR ")


COMPARES = " (with|or|than) "


def compares(text: Column, markers: str = COMPARES) -> Column:
    return F.concat(F.lit(" "), search_text(text), F.lit(" ")).rlike(markers)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
