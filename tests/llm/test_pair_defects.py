import numpy as np
from pyspark.sql import functions as F

from stillhouse.llm.pair_defects import DEFECTS, GRAMS, WIDTH, DefectParams, Languages, _probabilities, defects, features, learn_languages, train

SCHEMA = "id string, question string, answer_key string, key_points array<string>"


def test_features_of_odd_pairs():
    for q, a, k in [(None, None, None), ("", "", []), ("q?", "x" * 200_000, [None, ""]), ("¿?", "。", None), ("a", "<p></p>", ["a"])]:
        x = features(q, a, k, Languages({}))
        assert all(0 <= i < WIDTH for i in x) and np.isfinite(list(x.values())).all()


def test_languages_are_learnt(spark):
    rows = [("en", "Which of the samples has the higher density?"), ("de", "Welche der Proben hat die höhere Dichte und warum nicht?"), ("zh", "样品经溶剂萃取处理后的密度是多少"), (None, "no language"), ("en", None)]
    known = learn_languages(spark.createDataFrame(rows, "language string, question string"))
    told = lambda t: known.names[int(known.weigh(t).argmax())]
    assert known.names == ["de", "en", "zh"] and told("Die Dichte der Probe ist höher") == "de" and told("样品的密度") == "zh" and told("the density of the samples") == "en"
    assert not known.weigh("12 %").any()


def test_refusals_come_from_n_grams(spark):
    """Refusals worded as in no list stand far above sound answers of like length; with the weights of the n-grams taken away
    the distance (in log odds) shrinks to less than half."""
    qa = spark.read.parquet("/root/testdata/sf0.01/qa_benchmark.parquet")
    w, b, _, languages = train(qa)
    refused = ["I'm afraid I cannot answer questions on catalysts.", "Sorry, but I won't discuss this.", "I am not able to assist with the topic of sulfur."]
    sound = ["Heavy resins were found in the third fraction of it.", "Most of it stays in the residue.", "The sample of 1998 holds the most nickel of them.", "Asphaltenes remain, as the column was too hot."]
    at = DEFECTS.index("refusal")
    rows = [features("Which resin was found in the sample of 1998 and why?", a, None, languages) for a in refused + sound]
    score = lambda w: _probabilities([(list(x), list(x.values())) for x in rows], w, b)[:, at]
    odds = lambda p: np.log(p / (1 - p))
    gap = lambda p: odds(p)[: len(refused)].min() - odds(p)[len(refused) :].max()
    whole = gap(score(w))
    w = w.copy()
    w[:, :GRAMS] = 0
    print(whole, gap(score(w)))
    assert whole > 0 and gap(score(w)) < whole / 2


def test_made_defects_are_found(spark):
    qa = spark.read.parquet("/root/testdata/sf0.01/qa_benchmark.parquet").select("id", "question", "answer_key", "key_points")
    rows = [r for r in qa.orderBy("id").collect() if r["answer_key"] and len(r["answer_key"]) > 100 and r["answer_key"].rstrip().endswith(".") and r["question"]][:60]
    made = []
    for i, r in enumerate(rows):
        a = r["answer_key"].strip()
        kind = [None, "empty", "truncated", "refusal", "copied_question"][i % 5]
        new = {None: a, "empty": "n/a", "truncated": a[: a.rstrip(".").rfind(" ")][: -4], "refusal": "Sorry, I am not able to assist with that.", "copied_question": f"Q: {r['question']}"}[kind]
        made.append((f"t{i}", r["question"], new, r["key_points"], kind))
    table = qa.unionByName(spark.createDataFrame([m[:4] for m in made] + [(None, "q", "a", None), ("odd", None, None, None), ("odd", None, None, None)], SCHEMA)).withColumn("x", F.lit(1)).withColumn("defect", F.lit("clash"))
    got = {}
    for r in defects(table, DefectParams(sample_rows=250, iterations=40)).collect():
        got.setdefault(r["id"], set()).add(r["defect"])
    assert got["odd"] == {"empty"} and set().union(*got.values()) <= set(DEFECTS)
    right = sum(got.get(n, set()) == ({k} if k else set()) for n, _, _, _, k in made)
    assert right / len(made) > 0.85


def test_no_pairs(spark):
    assert defects(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_pairs_teach(spark):
    """Every pair takes part in the fit: a word that only rows of the last hundredth have gets a weight."""
    from stillhouse.llm.pair_defects import _bucket, _taught

    sentence = "The resin of sample {} was dissolved in warm toluene and then weighed again by hand."
    rows = [(f"r{i}", f"What was done with sample {i} and why?", sentence.format(i) + (" It held quuxite." if i >= 4000 else ""), None) for i in range(4040)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _taught(df, DefectParams()).count() == len(rows)
    assert learn_languages(df.withColumn("language", F.when(F.col("id") == "r4039", "rare").otherwise("en"))).names == ["en", "rare"]
    w, _, _, _ = train(df, DefectParams(first_iterations=2, iterations=2))
    assert np.abs(w[:, _bucket("w", "quuxite")]).max() > 0


def test_tasks_hold_few_examples():
    """However many pairs come in one batch, only the examples of a few of them are held at once, and each says the same as made alone."""
    from types import SimpleNamespace

    import pyarrow as pa

    from stillhouse.llm import pair_defects

    sentence = "The resin of sample {} was dissolved in warm toluene and then weighed again by hand. It held {} % sulfur."
    rows = [(f"r{i}", f"What was done with sample {i % 300} and why?", sentence.format(i, i % 9), [f"held {i % 9} % sulfur"]) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["id", "question", "answer_key", "key_points"])
    languages = Languages({"en": np.ones(pair_defects._LETTER_GRAMS)})
    run = pair_defects._examples(DefectParams(), [], ["resin"], SimpleNamespace(value=languages))
    made = list(run([batch]))
    assert max(m.num_rows for m in made) < 20 * 64 and len(languages.held) <= 256
    alone = [m for i in range(batch.num_rows) for m in run([batch.slice(i, 1)])]
    assert pa.Table.from_batches(made).to_pylist() == pa.Table.from_batches(alone).to_pylist()
