import json

import numpy as np
import pandas as pd
import pytest

from stillhouse.functions.plugins import Plugins
from stillhouse.operators.latent import pca_scores, pls_rotation, pls_scores
from stillhouse.sources.files import append_log, hash_import, load_documents, read_table, registered_sources, scan_files, write_jsonl


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_bytes(b"plain text \xff")
    (tmp_path / "a" / "two.MD").write_text("# head")
    (tmp_path / "three.json").write_text(json.dumps({"text": "inside", "n": 1}))
    (tmp_path / "four.json").write_text(json.dumps([{"text": "x"}, 3, {"other": 1}]))
    (tmp_path / "five.json").write_text("{broken")
    (tmp_path / "six.jsonl").write_text('{"text": "l0"}\n\nnot json\n{"k": 2}\n')
    (tmp_path / "seven.txt").write_text("  \n")
    (tmp_path / "eight.bin").write_text("no")
    (tmp_path / "nine.txt").write_bytes(b"plain text \xff")
    files = scan_files(spark, str(tmp_path))
    docs, bad = load_documents(files)
    got = sorted((r["source"].rsplit("/", 1)[1], r["section"] or "", r["text"]) for r in docs.collect())
    assert [(a, b) for a, b, _ in got] == [("four.json", "item_0"), ("four.json", "item_2"), ("nine.txt", ""), ("one.txt", ""), ("six.jsonl", "line_0"), ("six.jsonl", "line_2"), ("six.jsonl", "line_3"), ("three.json", ""), ("two.MD", "")]
    assert [r["source"].rsplit("/", 1)[1] for r in bad.collect()] == ["five.json"]
    assert sum(r["copy"] for r in hash_import(files).collect()) == 1
    registry = spark.createDataFrame([("all", f"file:{tmp_path}", True, "x"), ("a", f"file:{tmp_path}/a", True, "y"), ("off", f"file:{tmp_path}/a/one", False, "z")], "name string, path string, enabled boolean, hint string")
    assert {r["source"].rsplit("/", 1)[1]: r["registered"] for r in registered_sources(registry, docs).collect()}["one.txt"] == "a"


def test_tables_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿name,n\nx,1\n", encoding="utf-8")
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "t.csv")).select("name", "n").collect()] == [("x", 1)]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    write_jsonl(df, str(tmp_path / "o"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "o")).count() == 2
    for _ in range(2):
        append_log(df, str(tmp_path / "log"), "k")
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_plugins_run_only_when_reviewed(spark):
    p = Plugins()
    p.save("double", "k long, d long", lambda b: pd.DataFrame({"k": b["id"], "d": 2 * b["id"]}))
    with pytest.raises(PermissionError):
        p.apply(spark.range(2), "double")
    with pytest.raises(PermissionError):
        p.enable("double")
    p.review("double")
    p.enable("double")
    assert {(r["k"], r["d"]) for r in p.apply(spark.range(3), "double").collect()} == {(0, 0), (1, 2), (2, 4)}
    p.review("double", False)
    assert p.list() == [("double", False, False)]


def test_latent_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 6))
    x -= x.mean(axis=0)
    y = x[:, 0] - 2 * x[:, 3] + rng.normal(size=40) * 0.1
    rows = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, x array<double>, y double")
    got = np.zeros((40, 3))
    for r in pca_scores(rows, rows, 3).collect():
        got[r["id"], r["component"] - 1] = r["score"]
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6)
    # NIPALS on the rows themselves
    xd, yd, ts = x.copy(), y - y.mean(), []
    for _ in range(3):
        w = xd.T @ yd
        w /= np.linalg.norm(w)
        t = xd @ w
        xd, yd = xd - np.outer(t, xd.T @ t / (t @ t)), yd - t * (yd @ t / (t @ t))
        ts.append(t)
    got = np.zeros((40, 3))
    for r in pls_scores(rows, rows, 3).collect():
        got[r["id"], r["component"] - 1] = r["score"]
    assert np.allclose(got, np.array(ts).T, atol=1e-6)
    assert pls_rotation(np.zeros((2, 2)), np.zeros(2), 2).shape == (2, 0)
    assert pls_scores(rows.limit(0), rows, 2).count() == 0 and pca_scores(rows.limit(0), rows, 2).count() == 0
