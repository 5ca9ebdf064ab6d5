import pytest

from treeline.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_without_rows_and_with_nulls(spark, bare_tables, name):
    assert [QUERIES[name](spark, d).count() for d in bare_tables] == [0, 0]


def test_columns(spark, sf_dir):
    small = sf_dir.replace("sf0.01", "sf0.001")
    assert QUERIES["p2_found"](spark, small).columns == ["node_id"]
    assert QUERIES["p6_found"](spark, small).dtypes == [("sig_id_a", "bigint"), ("sig_id_b", "bigint")]
    assert QUERIES["p8_found"](spark, small).dtypes == [("doc_id", "bigint"), ("item_id", "bigint")]
    assert QUERIES["p9_found"](spark, small).dtypes == [("doc_id", "bigint"), ("reading_band", "bigint")]
