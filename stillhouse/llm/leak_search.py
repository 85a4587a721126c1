"""Held-out passages inside training documents, found with suffix arrays of the training words.

Each task builds suffix arrays over shards of its documents (word level, whole documents) and binary-searches
every suffix of the test items in them; matches are extended to the longest verbatim run and located.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse.llm.words import WORD


@dataclass(frozen=True)
class LeakParams:
    """shard_words bounds a suffix array (a longer document has one of its own); item_bytes bounds a block of
    test text, pass_blocks the blocks sent to the tasks at once: more test text is worked off in several passes."""

    least_words: int = 10
    shard_words: int = 400_000
    item_bytes: int = 8_000_000
    pass_blocks: int = 8


class _Vocabulary(dict):
    def __missing__(self, word: str) -> int:
        x = self[word] = len(self)
        return x


def _suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``ids`` in the order of their first ``depth`` (or more) values, by rank doubling."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    span = 1
    order = np.argsort(rank, kind="stable")
    while span < depth:
        ahead = np.zeros_like(rank)
        ahead[:-span] = rank[span:]
        key = rank * (rank.max() + 2) + ahead
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.r_[1, (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)])
        rank, span = new, span * 2
        if rank.max() == len(rank):
            break
    return order


def _bound(text: np.ndarray, order: np.ndarray, probes: np.ndarray, upper: bool) -> np.ndarray:
    """For each row of ``probes`` the first place in ``order`` whose suffix is not below it (upper: is above it)."""
    n, depth = len(order), probes.shape[1]
    lo, hi = np.zeros(len(probes), np.int64), np.full(len(probes), n, np.int64)
    padded = np.r_[text, np.full(depth, -1, text.dtype)]
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        words = padded[order[mid][:, None] + np.arange(depth)[None, :]]
        diff = words - probes[open_]
        at = (diff != 0).argmax(axis=1)
        first = diff[np.arange(len(diff)), at]
        below = (first <= 0) if upper else (first < 0)
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]


def _search_shard(doc_ids: list, words: list[np.ndarray], items: list[tuple[int, np.ndarray]], least: int) -> list[tuple]:
    """(doc, item, words, doc position, item position) of the longest verbatim match of each pair."""
    sizes = np.array([len(w) for w in words])
    starts = np.r_[0, np.cumsum(sizes + 1)]
    text = np.full(starts[-1], -1, dtype=np.int64)
    top = max((int(w.max()) for w in words if len(w)), default=0)
    for k, w in enumerate(words):
        text[starts[k] : starts[k] + len(w)] = w
        text[starts[k] + len(w)] = top + 1 + k  # ends no match
    order = _suffix_array(text, least)
    rows = [(i, p) for i, (_, w) in enumerate(items) for p in range(len(w) - least + 1)]
    if not rows:
        return []
    who = np.array(rows)
    probes = np.stack([items[i][1][p : p + least] for i, p in rows])
    some = (probes >= 0).all(axis=1)  # a word that the shard lacks is -1
    who, probes = who[some], probes[some]
    if not len(who):
        return []
    first, last = _bound(text, order, probes, False), _bound(text, order, probes, True)
    found: dict[tuple, tuple] = {}
    done: dict[tuple, int] = {}  # the diagonal (place in text - place in item) of a match that was extended, with its end
    for (i, p), lo, hi in zip(who, first, last):
        item = items[i][1]
        for at in order[lo:hi].tolist():
            line = (i, at - p)
            if done.get(line, -1) >= p + least:
                continue
            n = least
            while p + n < len(item) and at + n < len(text) and text[at + n] == item[p + n]:
                n += 1
            done[line] = p + n
            doc = int(np.searchsorted(starts, at, side="right")) - 1
            key = (doc_ids[doc], items[i][0])
            best = (n, -(at - int(starts[doc])), -p)
            if key not in found or best > found[key]:
                found[key] = best
    return [(d, i, n, -a, -p) for (d, i), (n, a, p) in found.items()]


def leaks(documents: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id, words, doc_word, item_word): the longest verbatim run of each pair with at least least_words.

    ``documents`` has doc_id and text, ``items`` item_id and text (bigint ids). Words are maximal runs of letters and
    digits, lower-cased. Null and short texts match nothing; repeated rows come out once; an empty side gives an
    empty result. Documents aren't shuffled; test items are sent to every task in bounded blocks.
    """
    spark = documents.sparkSession
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-int(total) // params.item_bytes))
    schema = "doc_id bigint, item_id bigint, words int, doc_word int, item_word int"
    out = None
    for k in range(passes):
        block = items.filter("item_id is not null and text is not null").filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        texts = spark.sparkContext.broadcast([(r[0], WORD.findall(r[1].lower())) for r in block.select("item_id", "text").distinct().collect()])

        def run(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            vocabulary = _Vocabulary()
            ids, words, size = [], [], 0

            def flush() -> pa.RecordBatch:
                own = [(i, np.array([vocabulary.get(x, -1) for x in w], dtype=np.int64)) for i, w in texts.value]
                rows = _search_shard(ids, words, own, params.least_words)
                cols = list(zip(*rows)) or [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["doc_id", "item_id", "words", "doc_word", "item_word"])

            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    found = WORD.findall(text.lower()) if text else []
                    if doc is None or len(found) < params.least_words:
                        continue
                    if words and size + len(found) > params.shard_words:
                        yield flush()
                        ids, words, size = [], [], 0
                        if len(vocabulary) > 2_000_000:
                            vocabulary = _Vocabulary()
                    ids.append(doc)
                    words.append(np.fromiter(map(vocabulary.__getitem__, found), dtype=np.int64, count=len(found)))
                    size += len(found)
            if words:
                yield flush()

        part = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.words").alias("words"), (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"))
