import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stillhouse.llm.packing import PackParams, best_fit, complete_bins, pack, pieces
from stillhouse.llm.leak_search import LeakParams, leaks
from stillhouse.llm.words import WORD


def fewest(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bin_completion_is_exact(sizes):
    bins = complete_bins(sizes, 20, 20_000, 400)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 20 for b in bins)
    assert len(bins) == fewest(sizes, 20) <= len(best_fit(sorted(sizes, reverse=True), 20))


def test_bin_completion_beats_best_fit():
    sizes = [6, 5, 4, 4, 3, 2, 6, 5, 4, 4, 3, 2, 7, 3]
    assert len(complete_bins(sizes, 10, 5_000, 40)) == fewest(sizes, 10)


def test_search_goes_on_at_every_depth():
    """A thousand items of middling size, where best fit is far from the bound: completion needs fewer containers."""
    rnd = random.Random(4)
    sizes = [rnd.randint(300, 1_400) for _ in range(400)]
    bins = complete_bins(sizes, 2_048, 3_000, 40)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and max(map(sum, bins)) <= 2_048
    assert len(bins) < len(best_fit(sorted(sizes, reverse=True), 2_048))


def test_packing_keeps_every_piece(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word " * 9_000)], "doc_id bigint, text string"))
    params = PackParams(group_items=30)
    want = sorted((r["doc_id"], r["piece"], r["tokens"]) for r in pieces(docs, params).collect())
    got = pack(docs.withColumn("container", F.lit(1)).withColumn("group", F.lit(1)), params).collect()
    assert sorted((r["doc_id"], r["piece"], r["tokens"]) for r in got) == want
    filled = {}
    for r in got:
        filled[r["container"]] = filled.get(r["container"], 0) + r["tokens"]
    assert all(v <= 2_048 for v in filled.values()) and all(filled[r["container"]] == r["filled"] for r in got)
    long = [r["tokens"] for r in sorted(got, key=lambda r: r["piece"]) if r["doc_id"] == 10**6 + 2]
    assert len(long) > 1 and set(long[:-1]) == {2_048} and not any(r["doc_id"] in (10**6, 10**6 + 1) for r in got)
    assert pack(docs.limit(0), params).count() == 0


def brute(docs, items, least):
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for i, u in items:
            v = WORD.findall((u or "").lower())
            best = 0
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= least:
                out[d, i] = best
    return out


def test_leak_search_matches_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(14))) for i in range(6)] + [(90, None), (91, ""), (92, "w1 w2")]
    docs = []
    for d in range(40):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        if d % 3 == 0:
            v = items[d % 6][1].split()
            a = rnd.randint(0, 6)
            w[5:5] = v[a : a + rnd.randint(4, 10)]
        docs.append((d, " ".join(w).upper()))
    docs += [(100, None), (101, ""), (0, docs[0][1]), (102, "x " * 50_000)]
    dd = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(5)).withColumn("words", F.lit("clash"))
    ii = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    for params in (LeakParams(least_words=4), LeakParams(least_words=4, shard_words=60, item_bytes=120)):
        got = {(r["doc_id"], r["item_id"]): r["words"] for r in leaks(dd, ii, params).collect()}
        assert got == brute(docs, items, 4)
    assert leaks(dd.limit(0), ii).count() == 0 and leaks(dd, ii.limit(0)).count() == 0
