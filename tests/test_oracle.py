import importlib

import pytest
from oracle import duck_rows, rows_of

MODULES = ["data_quality", "retrieval", "corpus", "graph", "knn", "curves", "evalkit", "catalog", "records", "evidence"]
PAIRS = [(m, k) for m in MODULES for k in importlib.import_module(f"stillhouse.plans.{m}").SQL]


@pytest.mark.parametrize("module,name", PAIRS, ids=[k for _, k in PAIRS])
def test_same_rows(spark, small, module, name):
    m = importlib.import_module(f"stillhouse.plans.{module}")
    assert rows_of(m.QUERIES[name](spark, small)) == duck_rows(m.SQL[name], small)
