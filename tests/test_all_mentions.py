from stillhouse.plans import catalog, corpus


def test_later_years_and_entries_count(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "In 1999 2001, and 1999 again; x2003"), (2, "2001"), (3, None)], "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    assert {tuple(r) for r in corpus.year_mentions_all(spark, d).collect()} == {(1999, 1), (2001, 2)}
    spark.createDataFrame([("s", i, f"S-{500 - i:03d}") for i in range(50)] + [(None, 90, "none")], "source string, entry_id bigint, raw_sample_id string").write.parquet(f"{d}/manifest.parquet")
    got = {(r["source"], r["entry_id"]): (r["number"], r["r"]) for r in catalog.natural_order_all(spark, d).collect()}
    assert got == {("s", i): (500 - i, 50 - i) for i in range(50)} | {(None, 90): (None, 1)}
