"""Tables kept in buckets of a key."""

import pytest

from tests.conftest import rows
from wardlens.sources.buckets import _name, read_bucketed, write_bucketed


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [(k % 50, None if k % 7 == 0 else f"a{k % 3}", k, f"it's {k}") for k in range(400)],
        "id long, adm_id string, n int, `odd name` string",
    )


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def test_joins_and_groups_by_the_key_need_no_shuffle(spark, table, tmp_path, no_broadcast):
    kept = write_bucketed(table, str(tmp_path / "a's table"), ["id", "adm_id"], 5)
    assert rows(kept) == rows(table)
    facts = kept.groupBy("id", "adm_id").max("n")
    joined = kept.join(facts, ["id", "adm_id"], "left")
    assert "Exchange" not in _plan(joined) and joined.count() == 400
    other = write_bucketed(facts.withColumnRenamed("max(n)", "most"), str(tmp_path / "facts"), ["id", "adm_id"], 5)
    assert "Exchange" not in _plan(kept.join(other, ["id", "adm_id"]))
    assert rows(kept.join(other, ["id", "adm_id"])) == rows(table.join(facts.withColumnRenamed("max(n)", "most"), ["id", "adm_id"]))


def test_a_session_without_the_entry_makes_it_anew(spark, table, tmp_path, no_broadcast):
    path = str(tmp_path / "a's table")
    write_bucketed(table, path, ["id", "adm_id"], 4)
    spark.sql(f"DROP TABLE {_name(path)}")
    again = read_bucketed(spark, path)
    assert rows(again) == rows(table) and again.columns == table.columns
    assert "Exchange" not in _plan(again.groupBy("id", "adm_id").count())
    assert rows(read_bucketed(spark, path)) == rows(table)


def test_one_file_for_each_bucket_and_no_table_twice(spark, table, tmp_path):
    path = tmp_path / "t"
    write_bucketed(table, str(path), ["id"], 3)
    assert len(list(path.glob("*.parquet"))) == 3
    with pytest.raises(Exception, match="exist"):
        write_bucketed(table, str(path), ["id"], 3)
    again = write_bucketed(table.limit(10), str(path), ["id"], 3, mode="overwrite")
    assert again.count() == 10


def test_empty_table(spark, table, tmp_path):
    kept = write_bucketed(table.limit(0), str(tmp_path / "none"), ["id"], 3)
    assert kept.count() == 0 and kept.columns == table.columns
