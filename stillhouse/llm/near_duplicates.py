"""Near-copied texts by multi-index hashing.

Each text gets a fingerprint of min-hash symbols over its word shingles. The fingerprint is cut into segments;
within each segment the Hamming ball of radius one is enumerated (every choice of one symbol that may differ),
the tables of those keys are joined, complete Hamming distances of the fingerprints are checked and finally
the exact share of common shingles. Exact copies are folded into one representative before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillhouse.llm.components import components
from stillhouse.llm.words import WordIds, mix, shingles, word_ids
from stillhouse.sources.tables import stage


@dataclass(frozen=True)
class NearParams:
    """A pair at the similarity limit s keeps a segment of four symbols but for one with chance s^4 + 4 s^3 (1-s); two of
    the 32 segments must be kept, which unrelated texts that share a few phrases hardly ever manage. The defaults miss a
    pair right at 0.45 once in 600, at 0.55 once in 400,000."""

    width: int = 5
    similarity: float = 0.8
    segments: int = 32
    seed: int = 5


_SYMBOLS = 4
_KEPT_SEGMENTS = 2


def _fingerprints(params: NearParams, kind: str):
    symbols = params.segments * _SYMBOLS
    rng = np.random.default_rng(params.seed)
    mult = (rng.integers(1, 2**63, symbols, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    salt = rng.integers(0, 2**63, symbols, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordIds()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, ends = word_ids(part.column("text").to_pylist(), cache)
                keep, sets, prints, whole, short = [], [], [], [], []
                parts = part.column("part").to_pylist()
                for i in range(part.num_rows):
                    words = ids[ends[i] : ends[i + 1]]
                    s = np.unique(shingles(words, params.width))
                    short.append(not len(s))
                    if not len(s):  # too short for a shingle: alike only as a whole
                        s = mix(shingles(words, len(words)) + np.uint64(len(words))) if len(words) else np.zeros(1, dtype=np.uint64)
                    own = np.uint64(xxhash.xxh3_64_intdigest(parts[i] or ""))
                    low = np.full(symbols, np.iinfo(np.uint64).max, dtype=np.uint64)
                    for k in range(0, len(s), 1024):  # a very long text in slices
                        x = s[k : k + 1024, None] * mult[None, :]
                        x += salt[None, :]
                        x ^= x >> np.uint64(29)
                        x *= np.uint64(0xBF58476D1CE4E5B9)
                        low = np.minimum(low, x.min(axis=0))
                    keep.append(i)
                    sets.append(s.view(np.int64))
                    prints.append(mix(low ^ own).view(np.int64).astype(np.int32))
                    whole.append(f"{parts[i] or ''}:{short[-1]:d}:{int(np.bitwise_xor.reduce(mix(s))):016x}{int(np.add.reduce(mix(s ^ np.uint64(7)))):016x}{len(s)}")
                if keep:
                    lists = lambda xs, t: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate(xs), t))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(keep)), pa.array(whole), lists(sets, pa.int64()), lists(prints, pa.int32()), pa.array(short)], ["id", "same", "shingles", "print", "short"])

    return run, f"id {kind}, same string, shingles array<bigint>, print array<int>, short boolean"


def _segment_keys(params: NearParams):
    """Rows (no, segment, key): in each segment of a fingerprint the keys of its Hamming ball, one symbol left open at a time."""
    places = np.arange(params.segments * _SYMBOLS).reshape(params.segments, _SYMBOLS)
    salt = np.arange(params.segments, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                flat = part.column("print").flatten().to_numpy()
                seg = flat.reshape(-1, params.segments * _SYMBOLS)[:, places].astype(np.uint32).astype(np.uint64)  # rows x segments x symbols
                ball = np.empty((*seg.shape[:2], _SYMBOLS), dtype=np.uint64)
                for free in range(_SYMBOLS):
                    h = np.full(seg.shape[:2], free + 1, dtype=np.uint64)
                    for k in range(_SYMBOLS):
                        if k != free:
                            h = mix(h * np.uint64(131) + seg[:, :, k])
                    ball[:, :, free] = mix(h + salt[None, :])
                n = params.segments * _SYMBOLS
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("no").to_numpy(), n)), pa.array(np.tile(np.repeat(np.arange(params.segments, dtype=np.int32), _SYMBOLS), part.num_rows)), pa.array(ball.ravel().view(np.int64))], ["no", "segment", "key"]
                )

    return run


def near_links(texts: DataFrame, params: NearParams = NearParams()) -> tuple[DataFrame, DataFrame]:
    """Links between different texts and the membership of copies.

    ``texts`` has columns id and text, and part where only texts of one part are to be compared. Returns (links: a, b,
    similarity with a < b, ids of representatives) and (members: id, representative, short). Texts of a part with
    the same set of shingles share a representative, their smallest id. Texts shorter than a shingle (null and empty
    ones too) are ``short``: they share a representative if their words are the same, and have no links. An id that stands
    there several times with one text counts once. No partner or candidate is dropped.
    """
    if params.segments > 63:
        raise ValueError("at most 63 segments")
    run, schema = _fingerprints(params, dict(texts.dtypes)["id"])
    own = texts if "part" in texts.columns else texts.withColumn("part", F.lit(None).cast("string"))
    marked = stage(own.select("id", "text", "part").filter("id is not null").mapInArrow(run, schema).withColumn("no", F.monotonically_increasing_id()))
    first = marked.groupBy("same").agg(F.min(F.struct("id", "no")).alias("x"))
    members = stage(marked.select("same", "id", "short").distinct().join(first, "same").select("id", F.col("x.id").alias("representative"), "short"))
    # one row per set of shingles: the others are taken away by their numbers, so that the wide rows stay where they are
    others = stage(marked.select("same", "no").join(first, "same").filter("no <> x.no").select("no"))  # few unless copies abound: then its size is known to the planner
    one = marked.filter("not short").join(others, "no", "left_anti").select("no", F.col("id").alias("rep"), "shingles", "print")
    keys = one.select("no", "print").mapInArrow(_segment_keys(params), "no bigint, segment int, key bigint")
    left, right = keys.select(F.col("no").alias("na"), "key", "segment"), keys.select(F.col("no").alias("nb"), "key", F.col("segment").alias("s2"))  # alike on both sides: one shuffle serves both
    kept = F.bit_count(F.expr("bit_or(shiftleft(1L, segment))"))
    met = left.join(right, "key").filter("na < nb").groupBy("na", "nb").agg(kept.alias("kept")).filter(F.col("kept") >= min(_KEPT_SEGMENTS, params.segments)).select("na", "nb")
    pairs = stage(met)
    body = one.join(pairs.select(F.explode(F.array("na", "nb")).alias("no")).distinct(), "no", "left_semi")
    a = body.select(*[F.col(c).alias(f"{c}_a") for c in body.columns])
    b = body.select(*[F.col(c).alias(f"{c}_b") for c in body.columns])
    joined = pairs.join(a, pairs["na"] == a["no_a"]).join(b, F.col("nb") == b["no_b"])
    symbols = params.segments * _SYMBOLS
    slack = 4.5 * (params.similarity * (1 - params.similarity) * symbols) ** 0.5
    agree = F.size(F.filter(F.zip_with("print_a", "print_b", lambda x, y: x == y), lambda x: x))
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    similarity = F.col("common") / (F.size("shingles_a") + F.size("shingles_b") - F.col("common"))
    near = joined.filter(agree >= int(max(1, params.similarity * symbols - slack))).withColumn("common", common).withColumn("similarity", similarity)
    links = near.filter(F.col("similarity") >= params.similarity).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), "similarity")
    return stage(links), members


def near_pairs(texts: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """All pairs (id_a < id_b) of different ids at or above the similarity, copies included. Texts without a shingle have no
    similarity and stand in no pair."""
    links, members = near_links(texts, params)
    who = members.filter("not short").select(F.col("representative").alias("r"), "id")
    across = links.join(who.select(F.col("r").alias("a"), F.col("id").alias("x")), "a").join(who.select(F.col("r").alias("b"), F.col("id").alias("y")), "b")
    copies = who.withColumnRenamed("id", "x").join(who.withColumnRenamed("id", "y"), "r").filter("x < y")
    both = across.select("x", "y").unionByName(copies.select("x", "y")).filter("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_groups(texts: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """One row per id: id, group_id (smallest member of its linked group), copies_of, links.

    ``links`` counts the linked different texts; ``copies_of`` is the representative of its exact copies."""
    links, members = near_links(texts, params)
    comp = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("representative")).groupBy("representative").agg(F.count("*").alias("links"))
    out = members.join(comp.withColumnRenamed("node", "representative"), "representative", "left").join(degree, "representative", "left")
    return out.select("id", F.coalesce("component", "representative").alias("group_id"), F.col("representative").alias("copies_of"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
