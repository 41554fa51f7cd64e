import pytest

from ratingloom.operators import linalg
from ratingloom.plans.registry import ORACLES, QUERIES

from .helpers import duck, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert same(QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir).execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["tag_count_params", "tag_ls_agreement", "als_fold_in", "title_tokens_stemmed", "search_stemmed", "recommend_tag_count", "recommend_tag_ls", "recommend_als3"])
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_als_covers_all_numbers_of_factors(spark, sf_dir):
    rows = QUERIES["als_eval_by_k"](spark, sf_dir).collect()
    assert [r["k"] for r in rows] == [3, 5, 7, 9, 11]


def test_least_squares_tells_whether_it_converged(spark, sf_dir):
    rows = QUERIES["cg_least_squares"](spark, sf_dir).select("iterations", "final_rr").distinct().collect()
    assert len(rows) == 1 and 10 < rows[0]["iterations"] <= 200 and rows[0]["final_rr"] is not None


def test_conjugate_gradients_join_no_entries_in_their_rounds(spark, sf_dir, monkeypatch):
    """The matrix is joined to a vector once, for b; rounds multiply blocks that stay where they are."""
    calls, plain = [], linalg.spmv
    monkeypatch.setattr(linalg, "spmv", lambda *a: calls.append(1) or plain(*a))
    got = QUERIES["cg_least_squares"](spark, sf_dir).collect()
    assert len(calls) == 1 and got[0]["iterations"] > 1
    x = {r["i"]: r["v"] for r in got}
    assert x.keys() == {r["item_id"] for r in QUERIES["item_degree"](spark, sf_dir).collect()}
