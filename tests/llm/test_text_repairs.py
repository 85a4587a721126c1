import random

import pytest
from pyspark.sql import functions as F

from stillhouse.llm.encoding_repair import repaired
from stillhouse.llm.scan_repair import BODY as TEXT, BREAK, HEADER, INSIDE, LineModel, _File, clean_paragraphs, line_features, line_model, noise_of, page_number, records_of, variants


@pytest.mark.parametrize("text,want", [("12", 12), ("- 12 -", 12), ("— 3 —", 3), ("· 4 ·", 4), ("5 / 8", 5), ("Page 4 of 9", 4), ("p. 7", 7), ("S. 22", 22), ("[9]", 9), ("xvi", 0), ("l3", 13), ("12.5", None), ("word", None), ("331.0   107.0", None), ("", None)])
def test_page_numbers(text, want):
    assert page_number(text) == want


def test_variants():
    assert "concentrate" in variants("coricentrate") and "fines" in variants("fmes") and variants("") == []


def tables(spark, pages, chunks):
    p = spark.createDataFrame(pages, "page_id bigint, text string, source string, file_name string, page int, section string, title string, authors array<string>, year int, journal string, doi string")
    c = spark.createDataFrame(chunks, "chunk_id string, text string, metadata struct<page int, title string, journal string, authors array<string>, file_name string>")
    return p, c


def page(no, text, at=2, file="f.pdf", title="On the storage of resins", journal="Notes on Oil"):
    return (no, text, "s", file, at, None, title, ["A. Smith"], 2000, journal, None)


BODY = "Heavy resins were measured in the crude over many\nreplicate runs and the solvent was changed between\nthem. The storage tank held the resins for a week."


def test_noise_and_repair(spark):
    clean = [page(100 + i, f"Heavy resins were measured in the crude over many\nreplicate runs and the solvent was changed between\nthem. The storage tank held the resins for week {i}.", 3, f"g{i}.pdf") for i in range(30)]
    noisy = [
        page(1, "NOTES ON OIL\n\n" + BODY + "\n\n7", 2), page(2, BODY.replace("replicate runs and the solvent was changed", "repli-\ncate runs and the sol-\nvent was changed") + "\n\n8", 3), page(3, BODY.replace("solvent", "so1vent"), 4), page(4, "On the storage of resins\nA. Smith\n\n" + BODY, 1),
        page(5, None), page(6, ""), page(7, "x" * 100_000, 9), (None, BODY, None, None, None, None, None, None, None, None, None), page(8, "See the long-\nchain compounds.", 5), page(9, BODY + "\n\n12.1   13.2\n14.2   15.1\n66\n\n" + BODY, 6, "h.pdf"),
    ]
    # longer pages, from whose insides the line model learns
    long = lambda i: "\n".join(f"{x}\n{y}\n{z} {i}." for x, y, z in [("Heavy resins were measured in the crude over many", "replicate runs and the solvent was changed between", "them. The storage tank held the resins for week"), ("The solvent was changed in the storage tank over", "many runs and the resins were measured between", "them. Replicate runs held the heavy crude for week")] * 3)
    clean += [page(300 + i, long(i), 3, f"m{i}.pdf", f"Resins of the crude {i}") for i in range(40)]
    clean += [page(200 + i, "A long-chain compound was found.", 3, f"k{i}.pdf") for i in range(12)]
    chunks = [("c1", BODY.replace("many\n", "many\nS. 22\nNotes on Oil, Vol. 3, No. 4\n"), (3, None, None, None, "f.pdf")), ("c1", BODY.replace("many\n", "many\nS. 22\nNotes on Oil, Vol. 3, No. 4\n"), (3, None, None, None, "f.pdf")), ("c2", BODY, None), (None, BODY, None)]
    p, c = tables(spark, clean + noisy, chunks)
    r = records_of(p.withColumn("noise", F.lit("clash")).withColumn("offset", F.lit(1)), c)
    got = {}
    for x in noise_of(r)[0].collect():
        got.setdefault(x["record_id"], set()).add(x["noise"])
    assert got == {"1": {"running_header", "page_number"}, "2": {"hyphenation", "page_number"}, "3": {"misread"}, "c1": {"running_header", "page_number"}}
    text = {x["record_id"]: x["clean_text"] for x in clean_paragraphs(r).collect()}
    flat = BODY.replace("\n", " ")
    assert text["1"] == text["2"] == text["3"] == text["c1"] == text["c2"] == flat and "5" not in text and "66" in text["9"]


def test_no_records(spark):
    p, c = tables(spark, [], [])
    r = records_of(p, c)
    assert noise_of(r)[0].count() == 0 and clean_paragraphs(r).count() == 0


def test_round_trips_of_wrong_encodings(spark, small):
    """Clean texts are decoded wrongly on purpose; they must be marked, most be restored to the letter, and others stay."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect() if r["text"]]
    before = {r["doc_id"]: r["garbled"] for r in repaired(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    good = [(i, t) for i, t in rows if not before[i]]
    rnd = random.Random(2)
    bad = {}
    for i, t in good:
        if not t.isascii() and rnd.random() < 0.08:
            wrong = rnd.choice(["latin-1", "cp437", "mac_roman", "cp850"])
            bad[i] = t.encode("utf-8").decode(wrong)
    df = spark.createDataFrame([(i, bad.get(i, t)) for i, t in good], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in repaired(df).collect()}
    truth = dict(good)
    assert len(bad) > 20 and sum(got[i]["garbled"] for i in bad) / len(bad) > 0.95
    assert sum(got[i]["text"] == truth[i] for i in bad) / len(bad) > 0.85
    assert sum(got[i]["garbled"] for i, _ in good if i not in bad) <= 0.01 * len(good)


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (4, "a�b"), (5, "x\x85y"), (6, "z" * 300_000), (None, "q")], "doc_id bigint, text string").withColumn("garbled", F.lit(1))
    got = {r["doc_id"]: (r["garbled"], r["text"]) for r in repaired(df).collect()}
    assert got[1] == (False, None) and got[2] == (False, "") and got[3] == (False, "plain") and got[4][0] and got[5][0] and not got[6][0] and len(got) == 7
    assert repaired(df.limit(0)).count() == 0


def test_the_line_model_decides(spark):
    """Headers come from the fitted model alone: without its weights no line is one. Lines inside a page never are."""
    pages = spark.read.parquet("/root/testdata/sf0.01/loaded_documents.parquet")
    chunks = spark.read.parquet("/root/testdata/sf0.01/document_chunks.parquet")
    model = line_model(records_of(pages, chunks))
    lines = ["NOTES ON OIL, Vol. 3, No. 4", ""] + [f"Heavy resins were measured in crude {i} over many" for i in range(8)] + ["", "— 7 —"]
    feats = line_features(lines, _File("On the storage of resins", "Notes on Oil", ["A. Smith"]), True, False, lambda n: n == 7)
    assert feats[1] is None and feats[6] is INSIDE
    assert model.labels(feats) == [HEADER, BREAK] + [TEXT] * 8 + [BREAK, HEADER]
    assert HEADER not in LineModel(model.steps, {}, -20.0, 0.5).labels(feats) and model.labels([]) == []
