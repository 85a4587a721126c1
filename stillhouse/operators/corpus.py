"""Text quality, labels and duplicates of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stillhouse.functions.text import alpha_ratio, normalize_text, word_count

# Forms of table rows, reference lists and acknowledgements, and cues of method sentences.
TABLE_FORM = r"(?i)(\b(m/z|ppm|rt|fid|tof|ei|esi|appi|api)\b|[%\d]\s*$|^[\w\-\+\./]+(\s+[\w\-\+\./]+){0,6}$)"
SYMBOLS_ONLY = r"^[\W\d_]+$"
REFERENCE_SECTION = r"(?i)^\s*(references|bibliography)\s*$"
ACKNOWLEDGEMENT = r"(?i)\b(acknowledg(e)?ments?|funding|author contributions?|conflicts? of interest|supporting information)\b"
METHOD_CUES = ["used to", "was used", "were used", "analyzed by", "measured by", "detected by", "characterized by", "an energy-dispersive", "gc×gc", "ft-icr", "mass spectrometry", "electrospray", "photoionization"]


def chunk_facts(text: Column, section: Column) -> dict[str, Column]:
    """What the rules below ask of a chunk; a null text counts as empty.

    words; letters (their share); row_form (reads like table cells); table (nothing, symbols only, two bars or more, or at most
    14 words in row form); back_matter (references or acknowledgements by section or first 240 characters); method.
    """
    t = F.coalesce(text, F.lit(""))
    flat, low, head = normalize_text(t), F.lower(t), F.coalesce(F.trim(section), F.lit(""))
    words, row_form = word_count(t), normalize_text(t).rlike(TABLE_FORM)
    return {
        "words": words, "letters": alpha_ratio(t), "row_form": row_form,
        "table": flat.rlike(f"^$|{SYMBOLS_ONLY}") | (F.regexp_count(flat, F.lit(r"\|")) >= 2) | (row_form & (words <= 14)),
        "back_matter": head.rlike(f"{REFERENCE_SECTION}|{ACKNOWLEDGEMENT}") | F.substring(t, 1, 240).rlike(ACKNOWLEDGEMENT),
        "method": F.greatest(*[low.contains(cue) for cue in METHOD_CUES]),
    }


def first_rule(rules: list[tuple[str | None, Column]], default: str | None = None) -> Column:
    """The name of the first rule whose condition holds; a rule named None stops the search without a name."""
    out = F.when(F.lit(False), F.lit(""))
    for name, holds in rules:
        out = out.when(holds, F.lit(name).cast("string"))
    return out.otherwise(F.lit(default).cast("string"))


def drop_reason(text: Column, section: Column, min_words: int = 40, max_words: int = 0, min_alpha: float = 0.55, keep_short_methods: bool = False) -> Column:
    """Why a chunk is dropped, the first rule that applies; null for one that stays. A null text counts as empty."""
    x = chunk_facts(text, section)
    short = x["words"] < min_words
    return first_rule([
        (None, short & x["method"] & F.lit(keep_short_methods)), ("short_table_fragment", short & x["table"]), ("too_short", short), ("too_long", (x["words"] > max_words) & F.lit(max_words > 0)),
        ("reference_or_ack", x["back_matter"]), ("low_alpha_ratio", x["letters"] < min_alpha), ("table_fragment", x["table"] & (x["words"] < 80)),
    ])


def quality_bucket(text: Column, section: Column) -> Column:
    """The first of the quality classes that a chunk falls into."""
    x = chunk_facts(text, section)
    short = x["words"] < 40
    return first_rule([
        ("short_table_fragment", short & x["row_form"]), ("short_fragment", short), ("reference_or_ack", x["back_matter"]), ("low_alpha_ratio", x["letters"] < 0.55),
        ("very_long", x["words"] >= 450), ("long", x["words"] >= 300),
    ], "normal")


def nearest_rank(values: DataFrame, shares: dict[str, float], keys: list[str]) -> DataFrame:
    """Per group of ``keys`` the value at index round((n - 1) * share) (half to even) for each share.

    Works on counts of distinct values, so that no group of rows is sorted in one task.
    """
    counts = values.filter("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("c"))
    run = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*keys)
    ranked = counts.withColumns({"upto": F.sum("c").over(run), "n": F.sum("c").over(everything)})
    at = lambda q: F.bround((F.col("n") - 1) * F.lit(float(q)))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > at(q), F.col("value"))).alias(name) for name, q in shares.items()])


def lexicon_tags(docs: DataFrame, id_col: str, text_col: str, lexicon: dict[str, list[str]]) -> DataFrame:
    """(id, tag): every tag of which a keyword stands in the lower-cased text. The lexicon is a small parameter."""
    low = F.lower(F.col(text_col))
    hit = lambda words: F.greatest(*[low.contains(w.lower()) for w in words], F.lit(False))
    tags = F.filter(F.array(*[F.when(hit(words), F.lit(tag)) for tag, words in lexicon.items()]), lambda x: x.isNotNull())
    return docs.select(F.col(id_col).alias("id"), F.explode(tags).alias("tag"))


def first_label(text: Column, hints: list[tuple[str, str]], default: str) -> Column:
    """The label of the first hint that stands in the lower-cased text."""
    out = F.when(F.lit(False), "")
    for hint, label in hints:
        out = out.when(F.lower(text).contains(hint.lower()), label)
    return out.otherwise(default)


def keep_latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(base: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``news`` in place of those with the same keys; among news the last in order of all columns wins."""
    fresh = keep_latest(news, keys, *[F.desc(c) for c in news.columns])
    return base.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def sentence_chunks(docs: DataFrame, budget: int = 384, overlap: int = 2) -> DataFrame:
    """(doc_id, chunk_no, chunk_text): sentences packed greedily up to ``budget`` words, the last ``overlap`` of a chunk
    opening the next; a longer sentence stands alone. Null and empty texts have no chunk."""
    import re

    end = re.compile(r"(?<=[。！？!?])\s+|(?<=[.!?])\s+(?=[A-Z0-9])|\n+")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                sentences = [s.strip() for s in end.split(text or "") if s.strip()]
                held: list[str] = []
                size, no, fresh = 0, 0, False
                for s in sentences:
                    n = len(s.split())
                    if fresh and size + n > budget:
                        rows.append((doc, no, " ".join(held)))
                        no += 1
                        held = held[-overlap:] if overlap else []
                        size = sum(len(x.split()) for x in held)
                        if size + n > budget:
                            held, size = [], 0
                        fresh = False
                    held.append(s)
                    size += n
                    fresh = True
                if fresh:
                    rows.append((doc, no, " ".join(held)))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "chunk_text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, chunk_no int, chunk_text string")
