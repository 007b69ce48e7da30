import pytest

from spindrift.queries import ORACLE_SQL, QUERIES, flagship

from .oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.01") > 0


def test_flagship(spark):
    assert compare(spark, "flagship", flagship, ORACLE_SQL["retrieval_metrics"], "/root/testdata/sf0.001") == 1


def test_word_count_drops_items(spark):
    sf = "/root/testdata/sf0.001"
    kept, whole = QUERIES["entity_text_filter"](spark, sf).count(), QUERIES["entity_text_labeled"](spark, sf).count()
    assert 0 < kept < whole
