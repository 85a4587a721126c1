"""Column expressions over texts: normalising, tokens, measures, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, spelled out so that other engines can use the same class.
SPACES = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# Fixed value: letters and digits, then at least one more of these or one of \ ] ^ _ / (the class that scores are defined with).
TOKEN = r"[A-Za-z0-9][A-Za-z0-9\\\]^_/]+"
CJK = r"[\x{4e00}-\x{9fff}]"


def normalize_text(x: Column) -> Column:
    """Runs of white space of any script as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(x, SPACES, " "))


def bm25_tokens(x: Column) -> Column:
    """Lower-cased word tokens of two or more characters, then single Chinese characters; null for null."""
    words = F.transform(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), F.lower)
    return F.concat(words, F.regexp_extract_all(x, F.lit(CJK), F.lit(0)))


def word_count(x: Column) -> Column:
    """Number of runs of non-space characters."""
    t = normalize_text(x)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def alpha_ratio(x: Column) -> Column:
    """Share of letters among all characters; 0 for an empty text."""
    return F.when(F.length(x) == 0, 0.0).otherwise(F.length(F.regexp_replace(x, r"\P{L}", "")).cast("double") / F.length(x))


def approx_tokens(x: Column) -> Column:
    """A quarter of the characters, half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(x) / F.lit(4.0)).cast("int"))


def doc_key(doi: Column, title: Column, year: Column, file_name: Column, source: Column) -> Column:
    """doi, else title and year, else file and source."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(~blank(doi), F.concat(F.lit("doi:"), F.trim(doi)))
        .when(~blank(title), F.concat(F.lit("title:"), F.trim(title), F.lit("::"), F.coalesce(year.cast("string"), F.lit(""))))
        .otherwise(F.concat(F.lit("file:"), F.coalesce(file_name, F.lit("")), F.lit("::"), F.coalesce(source, F.lit(""))))
    )


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    """md5 of source, index and the first 200 characters, joined by vertical bars."""
    return F.md5(F.concat_ws("|", source, index.cast("string"), F.substring(text, 1, 200)))
