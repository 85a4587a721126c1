"""Texts put into containers of a fixed number of tokens, by bin completion.

Items are dealt at random into groups of bounded size, one task each. A group starts from the best-fit
decreasing solution; bin completion then takes the largest item, enumerates the undominated fillings around it
and searches in order of discrepancy from the fullest ones, at every depth alike and pruned by the waste bound, while a
better number of containers is possible. Sparsely
filled containers of all groups are opened again and packed together in further rounds.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse.sources.tables import stage


@dataclass(frozen=True)
class PackParams:
    """nodes bounds the search of a group, which keeps its incumbent beyond; group_items is the size aimed at. fillings bounds the
    undominated fillings kept around one item, from at most four times as many maximal ones found in steps times as
    many steps. A search that ends within all of these is exact; the result is whole either way.
    Containers filled below ``open_below`` are opened for another round, ``rounds`` times at most."""

    capacity: int = 2_048
    group_items: int = 4_000
    nodes: int = 3_000
    fillings: int = 40
    steps: int = 60
    open_below: float = 0.97
    rounds: int = 2
    tokenizer: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    pattern: str = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pieces(texts: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """(doc_id, piece, tokens): whole texts up to the capacity; a longer one in pieces of exactly the capacity and a rest.

    Null and empty texts have no tokens and no piece. doc_id must not be null; rows are taken as they stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(params.tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=params.pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            ids, nos, sizes = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n = len(coder.encode_ordinary(text)) if text else 0
                no = 0
                while n > 0:
                    ids.append(doc), nos.append(no), sizes.append(min(n, params.capacity))
                    n, no = n - params.capacity, no + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(sizes, pa.int32())], ["doc_id", "piece", "tokens"])

    return texts.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, piece int, tokens int")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; ``sizes`` sorted from large to small. Bins hold indexes into sizes."""
    bins: list[list[int]] = []
    open_bins: list[tuple[int, int]] = []  # (free, bin), sorted
    for i, s in enumerate(sizes):
        at = bisect.bisect_left(open_bins, (s, -1))
        if at < len(open_bins):
            free, b = open_bins.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free - s > 0:
            bisect.insort(open_bins, (free - s, b))
    return bins


def _fillings(largest: int, rest: list[int], capacity: int, most: int, most_steps: int = 60) -> list[list[int]]:
    """Undominated sets of sizes from ``rest`` (descending) that fit beside ``largest``: maximal ones, fullest first."""
    room, out, seen = capacity - largest, [], set()
    steps = 0

    def extend(start: int, left: int, chosen: list[int]) -> None:
        nonlocal steps
        steps += 1
        if steps > most_steps * most or len(out) >= 4 * most:
            return
        grew, last = False, None
        at = bisect.bisect_left(rest, -left, key=lambda x: -x) if start == 0 else max(start, bisect.bisect_left(rest, -left, key=lambda x: -x))
        for k in range(at, len(rest)):
            s = rest[k]
            if s == last:
                continue  # equal items are interchangeable
            last = s
            grew = True
            extend(k + 1, left - s, [*chosen, s])
            if left == s:
                break  # a perfect fit dominates every smaller single item
            if len(out) >= 4 * most:
                break
        if not grew and tuple(chosen) not in seen:
            seen.add(tuple(chosen))
            out.append(chosen)

    extend(0, room, [])
    out.sort(key=lambda c: (-sum(c), len(c)))
    kept: list[list[int]] = []
    for c in out:
        # dominated: as many items, each no larger than those of a kept filling
        if not any(len(c) == len(x) and all(a <= b for a, b in zip(c, x)) for x in kept):
            kept.append(c)
        if len(kept) >= most:
            break
    return kept


def complete_bins(sizes: list[int], capacity: int, nodes: int, most: int, steps: int = 60) -> list[list[int]]:
    """Bins of sizes. Best fit first; while more bins than the waste bound allows, bin completion within ``nodes``: first the
    fullest fillings, then with one other choice anywhere, with two, four and so on."""
    sizes = sorted(sizes, reverse=True)
    incumbent = [[sizes[i] for i in b] for b in best_fit(sizes, capacity)]
    total = sum(sizes)
    bound = -(-total // capacity)
    left_nodes, skipped = nodes, False

    def search(rest: list[int], done: list[list[int]], waste: int, others: int) -> bool:
        """True when nothing is left to search for."""
        nonlocal incumbent, left_nodes, skipped
        path = []
        while rest:
            if len(done) + -(-sum(rest) // capacity) >= len(incumbent) or waste > (len(incumbent) - 1) * capacity - total:
                break
            left_nodes -= 1
            if left_nodes <= 0:
                return True
            options = _fillings(rest[0], rest[1:], capacity, most, steps)
            path.append((rest, done, waste, options))
            done, waste, rest = _filled(rest, done, waste, options[0])
        else:
            if len(done) < len(incumbent):
                incumbent = [list(b) for b in done]
            if len(incumbent) <= bound:
                return True
        for rest, done, waste, options in reversed(path):
            skipped = skipped or len(options) - 1 > others
            for j in range(1, min(others, len(options) - 1) + 1):
                then_done, then_waste, then_rest = _filled(rest, done, waste, options[j])
                if search(then_rest, then_done, then_waste, others - j):
                    return True
        return False

    def _filled(rest: list[int], done: list[list[int]], waste: int, filling: list[int]) -> tuple[list[list[int]], int, list[int]]:
        bin_ = [rest[0], *filling]
        return [*done, bin_], waste + capacity - sum(bin_), _without(rest, bin_)

    if len(incumbent) > bound:
        for others in (0, 1, 2, 4, 8, 16, 32, 64, 128):
            skipped = False
            if search(sizes, [], 0, others) or not skipped:
                break
    return incumbent


def _without(rest: list[int], used: list[int]) -> list[int]:
    rest = list(rest)
    for s in used:
        del rest[bisect.bisect_left(rest, -s, key=lambda x: -x)]
    return rest


def _pack_round(items: DataFrame, no: int, params: PackParams) -> DataFrame:
    groups = max(1, -(-items.count() // params.group_items))
    dealt = items.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(no)), F.lit(groups)).cast("int"))

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        by_size: dict[int, list[int]] = {}
        for i in range(len(rows) - 1, -1, -1):
            by_size.setdefault(int(rows["tokens"].iat[i]), []).append(i)
        bins = complete_bins(rows["tokens"].astype(int).tolist(), params.capacity, params.nodes, params.fillings, params.steps)
        where, filled = [0] * len(rows), [0] * len(rows)
        for b, sizes in enumerate(bins):
            total = sum(sizes)
            for s in sizes:
                i = by_size[s].pop()
                where[i], filled[i] = b, total
        return rows[["doc_id", "piece", "tokens"]].assign(container=[f"{no}-{key[0]}-{b}" for b in where], filled=filled)

    schema = "doc_id bigint, piece int, tokens int, container string, filled int"
    spread = dealt.repartition(groups, "group") if groups > 1 else dealt
    return spread.groupBy("group").applyInPandas(solve, schema)


def pack(texts: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """(doc_id, piece, tokens, container, filled): each text or piece with its container and that one's tokens.

    Full pieces fill a container alone. An empty table gives an empty result; texts that repeat under one doc_id and
    piece are kept as rows of their own. No container holds more than the capacity.
    """
    sized = stage(pieces(texts, params))
    alone = sized.filter(F.col("tokens") == params.capacity).select("doc_id", "piece", "tokens", F.concat(F.lit("full-"), "doc_id", F.lit("-"), "piece").alias("container"), F.col("tokens").alias("filled"))
    todo = sized.filter(F.col("tokens") < params.capacity)
    out = alone
    for no in range(params.rounds):
        packed = stage(_pack_round(todo, no, params))
        if no == params.rounds - 1:
            out = out.unionByName(packed)
            break
        loose = F.col("filled") < int(params.open_below * params.capacity)
        out = out.unionByName(packed.filter(~loose))
        todo = packed.filter(loose).select("doc_id", "piece", "tokens")
    return out
