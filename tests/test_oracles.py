"""Every core query with SQL gives the SQL's rows on the smallest tables."""

import os

import pytest

from scriptorium.plans import catalogue
from tests.compare import compare, views

WITHOUT = {"search_results", "title_answers", "indexed_nearest", "ranker_scores", "resolved_names", "word_suggestions", "word_excerpts", "corrected_elements", "vocabulary_repair", "merge_patterns", "title_candidates", "sampled_elements", "name_coverage"}
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, catalogue.QUERIES[name], catalogue.SQL[name]) is None


def test_every_query_has_sql_or_a_test_below():
    without = set(catalogue.QUERIES) - set(catalogue.SQL)
    # Each of these is tested against fixtures, brute force or a round trip.
    assert without == WITHOUT
