from test_text_repairs import BODY, page, tables

from stillhouse.llm.scan_repair import noise_of, records_of


def test_misread_words_in_many_records(spark):
    """A misreading is found however many records hold it: in copies of one text, and in 205 texts beside 1,700 sound ones."""
    week = lambda i: BODY.replace("a week", f"week {i}")
    pages = [page(i, week(i), 3, f"g{i}.pdf") for i in range(1700)]
    pages += [page(10_000 + i, week(10_000 + i).replace("measured", "rneasured"), 3, f"h{i}.pdf") for i in range(205)]
    pages += [page(20_000 + i, BODY.replace("solvent", "solverit"), 3, f"k{i}.pdf") for i in range(210)]
    p, c = tables(spark, pages, [])
    got = {int(x["record_id"]) for x in noise_of(records_of(p, c))[0].filter("noise = 'misread'").collect()}
    assert got == {10_000 + i for i in range(205)} | {20_000 + i for i in range(210)}
