import duckdb
import pytest

import __spark_entry__ as entry


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        return repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    small = sf_dir.replace("sf0.01", "sf0.001")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents nodes file_contents metric_values commits touches signatures export_payloads".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    rows = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rows.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rows.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_materialise_and_drop(spark):
    from treeline import session

    df = session.materialise(spark.range(5))
    assert df.count() == 5 and session.shared_folder(spark) in df.inputFiles()[0]
    assert session.drop_materialised(spark) > 0 and session.drop_materialised(spark) == 0
