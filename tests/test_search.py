"""The queries over the sweep and the text index run on whole tables and end where their inputs are empty."""

from conftest import DATA

from spanlight.plans import search


def test_search_queries_have_twins_and_rows(spark):
    assert set(search.QUERIES) == set(search.ORACLE_SQL)
    for name in ("sweep_windows", "text_phrases"):
        assert search.QUERIES[name](spark, DATA).count() > 0
