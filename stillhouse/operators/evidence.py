"""Evidence lists: coverage by equivalent documents, gates, merges that keep the first, terms and paragraph chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that make no term, alone or inside one, and endings of words that say little alone.
STOP_WORDS = "a an and are as at be been both but by did do does for from had has have in into is it its more most no not of on one only or per so such than that the their them then there these they this those to under was were what when where which while who why will with within without".split()
WEAK_ENDINGS = ["tion", "sion", "ment", "ness", "ally"]


def clean_ids(ids: Column) -> Column:
    """Distinct ids of an array, trimmed, without null and blank ones; an empty array for null."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def equivalent_coverage(groups: Column, predicted: Column) -> dict[str, Column]:
    """How many groups of equivalent documents a prediction hits: groups_total, groups_hit, coverage (1 without groups)."""
    found = clean_ids(predicted)
    total = F.size(F.coalesce(groups, F.array().cast("array<array<string>>")))
    hit = F.size(F.filter(F.coalesce(groups, F.array().cast("array<array<string>>")), lambda g: F.arrays_overlap(clean_ids(g), found)))
    return {"groups_total": total, "groups_hit": hit, "coverage": F.when(total == 0, 1.0).otherwise(hit / total)}


def evidence_gate(rows: DataFrame) -> DataFrame:
    """``rows`` (mode, gold, predicted, groups or null) with applied, strict_pass, soft_pass, strict_coverage and coverage.

    Groups missing means that each gold document stands for itself. Two-document rows pass strictly with all gold
    documents and softly with half of the groups; others strictly with any gold document and softly with all
    groups. Without gold documents the gate isn't applied and passes.
    """
    gold, found = clean_ids(F.col("gold")), clean_ids(F.col("predicted"))
    groups = F.when(F.size(F.coalesce("groups", F.array().cast("array<array<string>>"))) > 0, F.col("groups")).otherwise(F.transform(gold, lambda g: F.array(g)))
    soft = equivalent_coverage(groups, F.col("predicted"))
    n, hit = F.size(gold), F.size(F.array_intersect(gold, found))
    two = F.coalesce(F.col("mode") == "two_doc", F.lit(False))
    none = n == 0
    return rows.withColumns({
        "applied": ~none, "strict_pass": none | F.when(two, hit == n).otherwise(hit > 0), "soft_pass": none | F.when(two, soft["coverage"] >= 0.5).otherwise(soft["coverage"] >= 1.0),
        "strict_coverage": F.when(none, 1.0).otherwise(hit / n), "coverage": F.when(none, 1.0).otherwise(soft["coverage"]), "groups_total": F.when(none, 0).otherwise(soft["groups_total"]), "groups_hit": F.when(none, 0).otherwise(soft["groups_hit"]),
    })


def merge_first(lists: list[DataFrame], keys: list[str], id_col: str, most: int | None = None) -> DataFrame:
    """Ranked lists (keys, id_col, score) one behind the other: an id counts where it stands first, with its best score.

    Within a list the higher score comes first, then the smaller id; null scores come last. ``most`` keeps that many per
    key. Adds rank and origin (the number of the list).
    """
    out = None
    for no, rows in enumerate(lists):
        part = rows.select(*keys, id_col, F.col("score").cast("double").alias("score"), F.lit(no).alias("origin"))
        out = part if out is None else out.unionByName(part)
    g = out.groupBy(*keys, id_col).agg(F.min(F.struct("origin", (-F.coalesce("score", F.lit(float("-inf")))).alias("s"))).alias("first"), F.max("score").alias("score"))
    w = Window.partitionBy(*keys).orderBy("first.origin", "first.s", id_col)
    ranked = g.withColumn("rank", F.row_number().over(w))
    ranked = ranked if most is None else ranked.filter(F.col("rank") <= most)
    return ranked.select(*keys, id_col, "score", F.col("first.origin").alias("origin"), "rank")


def merge_annotations(selected: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Every row of either side once: fields of ``selected`` where they are set, else those of ``candidates``; selected tells which."""
    fields = [c for c in candidates.columns if c != key]
    s = selected.select(key, *[F.col(c).alias(f"_s_{c}") for c in fields], F.lit(True).alias("_in"))
    joined = s.join(candidates, key, "full_outer")
    return joined.select(key, *[F.coalesce(f"_s_{c}", c).alias(c) for c in fields], F.coalesce("_in", F.lit(False)).alias("selected"))


def bad_term(term: Column) -> Column:
    """Whether a term says nothing: blank, a stop word or with one inside, digits, or one short word or one with a weak ending."""
    low = F.lower(F.coalesce(term, F.lit("")))
    parts = F.split(low, " ")
    single = F.size(parts) == 1
    weak = F.lit(False)
    for e in WEAK_ENDINGS:
        weak = weak | low.endswith(e)
    return (low == "") | F.arrays_overlap(parts, F.array(*map(F.lit, STOP_WORDS))) | (single & ((F.length(low) < 3) | weak)) | low.rlike(r"^[0-9]+$")


def term_windows(text: Column, shortest: int, longest: int) -> Column:
    """All windows of ``shortest`` to ``longest`` words of a text, in small letters; words are runs of letters and digits."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))
    n = F.size(words)

    def windows(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(windows, range(shortest, longest + 1)))


def paragraph_chunks(text: Column, most: int = 800) -> Column:
    """Chunks of a text: paragraphs merged while they fit ``most`` characters, longer ones cut into pieces of exactly that and a
    rest, which nothing is merged with. Null and blank texts give no chunk."""
    paras = F.filter(F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, x: Column) -> Column:
        joined = F.when(acc["open"] == "", x).otherwise(F.concat(acc["open"], F.lit("\n\n"), x))
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda k: F.substring(x, k * most + 1, F.lit(most)))
        return (
            F.when(F.length(joined) <= most, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .when(F.length(x) <= most, F.struct(closed.alias("done"), x.alias("open")))
            .otherwise(F.struct(F.concat(closed, pieces).alias("done"), F.lit("").alias("open")))
        )

    return F.aggregate(paras, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
