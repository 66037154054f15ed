"""Every query of the library against its SQL."""

import pytest
from conftest import SF
from helpers import duck_rows, spark_rows

from tickloom.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(duck, ORACLE_SQL[name])


def write_ticks_in_tenths(folder):
    """A tick an hour, with prices whose averages are often equal."""
    import duckdb

    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(i) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, (217 + i * i * i * 20 % 997 % 3) / 10 AS value, '{{}}' AS props
        FROM range(600) t(i)) TO '{folder}/events.parquet'""")


@pytest.mark.parametrize("name", ["crossover_entries", "fills"])
def test_crossings_of_equal_averages_equal_their_sql(spark, tmp_path, name):
    import duckdb

    write_ticks_in_tenths(tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert spark_rows(QUERIES[name](spark, str(tmp_path))) == duck_rows(con, ORACLE_SQL[name])


@pytest.mark.parametrize("value", ["i * i * i * 20 % 2999 / 1000", "(i * i * i * 20 % 2999 - 1500) / 100000000", "(100000000 + i * i * i * 65 % 997 % 5) / 100000000"])
def test_fills_at_halves_equal_their_sql(spark, tmp_path, value):
    """A tick an hour. Fill prices of the first two lie at halves of the sixth digit, or round to minus zero; averages of the third at
    halves of the ninth."""
    import duckdb

    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(i) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, {value} AS value, '{{}}' AS props
        FROM range(300) t(i)) TO '{tmp_path}/events.parquet'""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert spark_rows(QUERIES["fills"](spark, str(tmp_path))) == duck_rows(con, ORACLE_SQL["fills"])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["symbol", "time", "open", "high", "low", "close", "tick_volume"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_subpackage(monkeypatch):
    """Whatever of it cannot be imported, the other queries are there."""
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def refusing(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", refusing)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)
