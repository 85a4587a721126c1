"""Records of evaluation splits that stand in the training split too, by an edit-distance segment join.

Evaluation strings are cut into k segments more than a pair must keep; a training string within k edits keeps all but
k of them, at allowed positions. Matches on (length, kept segments) are verified by banded dynamic
programming; only verified pairs are asked whether they name the same letters, number and cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillhouse.llm.components import components
from stillhouse.sources.tables import stage

# Full-width letters and digits and their plain forms.
_WIDE = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"
_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# File endings, and marks of copy or re-run behind an id.
_ENDING = r"\.(XLSX?|CSV|TSV|TXT|JSON|PDF|DAT)$"
_MARKS = r"(?:[\s_\-]*(?:\(\d+\)|COPY|DUP(?:LICATE)?|RE-?RUN(?:[\s_\-]*\d+)?|(?<=[\s_\-])R\d+))+\s*$"


def raw_parts(raw: Column) -> tuple[Column, Column]:
    """What a raw id names: (letters and cut as one text, number without leading zeros); nulls for null or blank.

    Paths, file endings, a leading "word:", and marks of copy or re-run don't matter; O between digits counts as
    0. An id of another form has a question mark in the first and its letters and digits in the second.
    """
    x = F.upper(F.translate(F.upper(raw), _WIDE, _PLAIN))
    x = F.regexp_replace(x, r"^.*[/\\]|^\s*[A-Z]+:", "")
    x = F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")), _ENDING, "")
    x = F.regexp_replace(x, _MARKS, "")
    form = r"^\s*([A-Z]+)(?:[^A-Z0-9]+|(?=[0-9]))([0-9O](?:[0-9O\s]*[0-9O])?)[^A-Z0-9]*(F[0-9])?\s*$"
    number = F.regexp_replace(F.translate(F.regexp_replace(F.regexp_extract(x, form, 2), r"\s", ""), "O", "0"), "^0+(?=.)", "")
    other = F.regexp_replace(F.upper(raw), r"[^\p{L}\p{N}]", "")
    kind = F.when(x.rlike(form), F.concat_ws("-", F.regexp_extract(x, form, 1), F.nullif(F.regexp_extract(x, form, 3), F.lit("")))).when(other != "", "?")
    return kind, F.when(x.rlike(form), number).when(other != "", other)


def folded_id(raw: Column) -> Column:
    """A raw id in plain capitals without path, ending, copy marks, separators and zero padding; a run of O counts once.

    What an id reads like, not what it names: misread and mistyped signs stay, and the edit join allows for them.
    """
    x = F.upper(F.translate(F.upper(raw), _WIDE, _PLAIN))
    x = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(x, r"^.*[/\\]|^\s*[A-Z]+:", ""), r"^\s+|\s+$", "")), _ENDING, "")
    x = F.regexp_replace(F.regexp_replace(x, _MARKS, ""), r"[^\p{L}\p{N}]", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(x, r"^([^0-9]*[^0-9])0+([0-9])", "$1$2"), "O+", "O"), F.lit(""))


#: Segments that a pair must keep. With one, keys are as short as half a string and name thousands; with
#: three of k + 3, a key holds most of the string, and what a key names grows far slower than the table.
KEPT = 3


def _segments(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and size of segments as even as possible, the longer ones last."""
    base, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def _eval_keys(k: int):
    """Every choice of k segments that may hold edits; the others make the key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s in b["s"]:
                cut = _segments(len(s), k + KEPT)
                for edited in combinations(range(len(cut)), k):
                    rows.append((s, f"{len(s)}|{edited}|" + "|".join(s[p : p + n] for i, (p, n) in enumerate(cut) if i not in edited)))
            yield pd.DataFrame(rows, columns=["s", "key"])

    return run


def _train_keys(k: int):
    """The same keys for every evaluation length within k: a segment stands where the edits before it have moved it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for s in b["s"]:
                for length in range(max(0, len(s) - k), len(s) + k + 1):
                    cut = _segments(length, k + KEPT)
                    moves = [m for m in product(range(-k, k + 1), repeat=k) if sum(m) == len(s) - length and sum(map(abs, m)) <= k]
                    for edited in combinations(range(len(cut)), k):
                        for m in moves:
                            by = dict(zip(edited, m))
                            kept, moved = [], 0
                            for i, (p, n) in enumerate(cut):
                                if i in by:
                                    moved += by[i]
                                elif 0 <= p + moved and p + moved + n <= len(s):
                                    kept.append(s[p + moved : p + moved + n])
                                else:
                                    break
                            else:
                                out.add((s, f"{length}|{edited}|" + "|".join(kept)))
            yield pd.DataFrame(list(out), columns=["s", "key"])

    return run


def banded_distance(a: list[str], b: list[str], k: int) -> np.ndarray:
    """Edit distance of each pair, k + 1 where it is above k; only the 2k + 1 diagonals around the main one are kept."""
    n = len(a)
    big = k + 1
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = max(1, int(max(la.max(initial=0), lb.max(initial=0))))
    grid = lambda xs: np.array([x.ljust(width, "\0") for x in xs], dtype=f"U{width}").view("U1").reshape(n, width) if n else np.empty((0, width), "U1")
    ga, gb = grid(a), grid(b)
    band = np.full((n, 2 * k + 1), big, dtype=np.int32)
    for d in range(-k, k + 1):
        if d >= 0:
            band[:, d + k] = d
    result = np.where((la == 0) & (lb <= k), lb, big)
    for i in range(1, width + 1):
        new = np.full_like(band, big)
        for c in range(2 * k + 1):
            j = i + c - k
            if j < 0 or j > width:
                continue
            if j == 0:
                new[:, c] = min(i, big)
                continue
            cost = band[:, c] + (ga[:, i - 1] != gb[:, j - 1])
            if c + 1 <= 2 * k:
                cost = np.minimum(cost, band[:, c + 1] + 1)
            if c >= 1:
                cost = np.minimum(cost, new[:, c - 1] + 1)
            new[:, c] = np.minimum(cost, big)
        band = new
        at = lb - i + k
        done = (la == i) & (at >= 0) & (at <= 2 * k)
        result[done] = band[done, at[done]]
    return np.minimum(result, big)


def edit_join(evaluation: DataFrame, training: DataFrame, k: int = 1) -> DataFrame:
    """(s_eval, s_train, edits) of distinct strings s within k edits.

    Repeated strings come out once, null ones not at all; the empty string is a string. A key holds all but k of
    k + 3 segments, so only strings alike share one, however often a string is repeated.
    """

    def keyed(df: DataFrame, run, name: str) -> DataFrame:
        return df.select("s").filter("s is not null").distinct().mapInPandas(run, "s string, key string").withColumnRenamed("s", name)

    pairs = keyed(evaluation, _eval_keys(k), "s_eval").join(keyed(training, _train_keys(k), "s_train"), "key").select("s_eval", "s_train").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(edits=banded_distance(b["s_eval"].tolist(), b["s_train"].tolist(), k))
            yield b[b["edits"] <= k]

    return pairs.mapInPandas(verify, "s_eval string, s_train string, edits int")


def split_groups(manifest: DataFrame, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """(entries with their group, the verified edit links: s_eval, s_train, edits, same).

    Entries: entry_id, part (train or eval), split, source, group. Equal trimmed sample ids, equal names within a
    part, and verified links of the two parts that name the same letters, number and cut put entries into one
    group, through any number of further entries; ``same`` tells such links from those of look-alikes. Null
    sample_id and raw id link nothing; splits other than train, test and valid (in any case, with blanks) are
    left out; repeated entry ids count once per form.
    """
    split = F.lower(F.trim("split"))
    rows = manifest.withColumn("_split", F.when(split.isin("valid", "validation", "val"), "valid").otherwise(split)).filter(F.col("_split").isin("train", "test", "valid") & F.col("entry_id").isNotNull())
    part = F.when(F.col("_split") == "train", "train").otherwise("eval")
    kind, number = raw_parts(F.col("raw_sample_id"))
    e = stage(rows.select("entry_id", part.alias("part"), F.col("_split").alias("split"), "source", F.nullif(F.lower(F.trim("sample_id")), F.lit("")).alias("sid"), F.concat_ws(":", kind, number).alias("name"), folded_id(F.col("raw_sample_id")).alias("s")))
    links = edit_join(e.filter("part = 'eval'"), e.filter("part = 'train'"), k)
    names = e.filter("s is not null").select("part", "s", "name").distinct()
    named = lambda p, s: names.filter(F.col("part") == p).select(F.col("s").alias(s), F.col("name").alias(f"name_{p}"))
    links = stage(links.join(named("eval", "s_eval"), "s_eval").join(named("train", "s_train"), "s_train").withColumn("same", F.col("name_eval") == F.col("name_train")))
    node = lambda p, c: F.concat_ws(":", p, c)
    sid, own = F.concat(F.lit("id:"), F.col("sid")), F.when(F.col("s").isNotNull(), node(F.col("part"), F.col("name")))
    same = links.filter("same").select(node(F.lit("eval"), "name_eval").alias("a"), node(F.lit("train"), "name_train").alias("b"))
    comp = components(e.select(F.coalesce(sid, own).alias("a"), F.coalesce(own, sid).alias("b")).unionByName(same))
    grouped = e.withColumn("node", F.coalesce(sid, own)).join(comp, "node").select("entry_id", "part", "split", "source", F.col("component").alias("group"))
    return stage(grouped.distinct()), links.groupBy("s_eval", "s_train", "edits").agg(F.max("same").alias("same"))


def split_pairs(grouped: DataFrame) -> DataFrame:
    """(entry_id_a, entry_id_b), a < b, one in train and one in an evaluation split, of one group."""
    t = grouped.filter("part = 'train'").select("group", F.col("entry_id").alias("t"))
    v = grouped.filter("part = 'eval'").select("group", F.col("entry_id").alias("v"))
    return t.join(v, "group").filter("t <> v").select(F.least("t", "v").alias("entry_id_a"), F.greatest("t", "v").alias("entry_id_b")).distinct()


def split_report(grouped: DataFrame) -> DataFrame:
    """Per evaluation split and source: entries and those whose group has a training entry."""
    trained = grouped.filter("part = 'train'").select("group").distinct().withColumn("hit", F.lit(1))
    return grouped.filter("part = 'eval'").join(trained, "group", "left").groupBy("split", "source").agg(F.count("*").alias("entries"), F.sum(F.coalesce("hit", F.lit(0))).alias("overlapping"))


def group_rows(grouped: DataFrame) -> DataFrame:
    """One row per entry: entry_id, split, source, class_id (the smallest entry id of its group) and partners, the number of
    entries of the group on the other side (train for an evaluation entry, else test and valid)."""
    ids = grouped.groupBy("group").agg(F.min("entry_id").alias("class_id"), F.countDistinct(F.when(F.col("part") == "train", F.col("entry_id"))).alias("_train"), F.countDistinct(F.when(F.col("part") == "eval", F.col("entry_id"))).alias("_eval"))
    return grouped.join(ids, "group").select("entry_id", "split", "source", "class_id", F.when(F.col("part") == "train", F.col("_eval")).otherwise(F.col("_train")).alias("partners"))
