import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stillhouse.llm.split_overlap import KEPT, _eval_keys, _segments, _train_keys, banded_distance, edit_join, folded_id, group_rows, raw_parts, split_groups, split_pairs, split_report


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=7), st.text("abc", max_size=7)), min_size=1, max_size=8), st.integers(0, 3))
def test_banded_distance(pairs, k):
    got = banded_distance([a for a, _ in pairs], [b for _, b in pairs], k).tolist()
    assert got == [min(distance(a, b), k + 1) for a, b in pairs]


@settings(max_examples=200, deadline=None)
@given(st.text("ab1", max_size=9), st.text("ab1", max_size=9), st.integers(0, 3))
def test_segments_lose_nothing(a, b, k):
    import pandas as pd

    e = set(next(_eval_keys(k)(iter([pd.DataFrame({"s": [a]})])))["key"])
    t = set(next(_train_keys(k)(iter([pd.DataFrame({"s": [b]})])))["key"])
    assert sum(n for _, n in _segments(len(a), k + KEPT)) == len(a)
    if distance(a, b) <= k:
        assert e & t


def test_edit_join(spark):
    a, b = ["KX123", "PF9", "Q", None, "KX123"], ["KX124", "KX1234", "PF99", "ZZZZ", "", None]
    got = {tuple(r) for r in edit_join(spark.createDataFrame([(x,) for x in a], "s string"), spark.createDataFrame([(x,) for x in b], "s string"), 1).collect()}
    assert got == {(x, y, distance(x, y)) for x in a if x for y in b if y is not None and distance(x, y) <= 1}
    assert edit_join(spark.createDataFrame([], "s string"), spark.createDataFrame([("a",)], "s string")).count() == 0


@pytest.mark.parametrize("raw,want", [("KX-00000156-F3", ("KX-F3", "156")), ("kx156_f3.csv", ("KX-F3", "156")), ("raw:KX.156.F3", ("KX-F3", "156")), ("uploads/2017/KX-00000156-F3.xlsx", ("KX-F3", "156")), ("KX-０００００１５６-F3", ("KX-F3", "156")), ("KX-OO000156-F3_rerun", ("KX-F3", "156")), ("  KX-0000 0156-F3\t", ("KX-F3", "156")), ("KX–00000156–F3 - Copy", ("KX-F3", "156")), ("KX-00000156-F3 (2)", ("KX-F3", "156")), ("KX-00000156_R2", ("KX", "156")), ("KX-00000156 rerun 1", ("KX", "156")), ("", (None, None)), (" ", (None, None)), (None, (None, None)), ("odd", ("?", "ODD"))])
def test_raw_keys(spark, raw, want):
    assert tuple(spark.createDataFrame([(raw,)], "r string").select(*raw_parts(F.col("r"))).first()) == want


def test_groups_through_a_third_entry(spark):
    rows = [(1, "s1", "KX-1", "train"), (2, "s2", "KX-0001_dup", " TEST "), (3, "s2", "PF-7", "valid"), (4, "s4", "pf7", "Train"), (5, None, None, "train"), (6, "s9", None, "test"), (7, " S9 ", "NR-2", "train"), (8, "s8", "KX-11", "test"), (9, None, "VGO-3-F1", "test"), (10, "x", "VGO-3", "train"), (11, "s1", "KX-1", "other"), (None, "s1", None, "train")]
    m = spark.createDataFrame(rows, "entry_id bigint, sample_id string, raw_sample_id string, split string").withColumn("source", F.lit("a")).withColumn("group", F.lit(1)).withColumn("s", F.lit("clash"))
    g, _ = split_groups(m)
    got = {tuple(r) for r in split_pairs(g).collect()}
    assert got == {(1, 2), (1, 3), (2, 4), (3, 4), (6, 7)}
    assert {(r["split"], r["entries"], r["overlapping"]) for r in split_report(g).collect()} == {("test", 4, 2), ("valid", 1, 1)}
    assert split_pairs(split_groups(m.limit(0))[0]).count() == 0
    rows = {r["entry_id"]: (r["class_id"], r["partners"]) for r in group_rows(g).collect()}
    assert rows[1] == (1, 2) and rows[4] == (1, 2) and rows[7] == (6, 1) and rows[10][1] == 0


def test_edits_find_what_equality_misses(spark):
    """A misread zero is within one edit and names the same sample; a look-alike within one edit doesn't."""
    rows = [(1, None, "NR-OO003185", "test"), (2, None, "nr3185.csv", "train"), (3, None, "NR-00003186", "train"), (4, None, "NR-3O15", "valid"), (5, None, "NR-00003015", "train")]
    m = spark.createDataFrame(rows, "entry_id bigint, sample_id string, raw_sample_id string, split string").withColumn("source", F.lit("a"))
    g, links = split_groups(m)
    assert {tuple(r) for r in split_pairs(g).collect()} == {(1, 2), (4, 5)}
    assert {(r["s_eval"], r["s_train"], r["edits"], r["same"]) for r in links.collect()} == {("NRO3185", "NR3185", 1, True), ("NR3O15", "NR3015", 1, True)}
    assert split_pairs(split_groups(m, k=0)[0]).count() == 0  # without edits both are lost


@pytest.mark.parametrize("raw,want", [("KX-00000156-F3", "KX156F3"), ("uploads/2017/kx156_f3 - Copy.csv", "KX156F3"), ("KX-OO000156", "KXO156"), ("KX-１５６", "KX156"), (" ", None), (None, None)])
def test_folded_ids(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(folded_id(F.col("r"))).first()[0] == want
