import pytest
from oracle import same

from inkloom.plans import more_oracles, oracles
from inkloom.plans.queries import queries

SQL = oracles.oracle_sql() | more_oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    same(spark, queries()[name], SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_query_gives_rows_and_repeats_them(spark, sf, name):
    """Queries that SQL can't express: rows, no null keys, and the same rows from a second plan."""
    first, second = queries()[name](spark, sf), queries()[name](spark, sf)
    keys = [c for c in first.columns if c in ("project_id", "page_index", "block_id")]
    rows = first.collect()
    assert rows and all(r[k] is not None for r in rows for k in keys)
    assert sorted(map(repr, rows)) == sorted(map(repr, second.collect()))


def test_contractions_end_where_sql_ends_them(spark, tmp_path):
    """Letters beyond ASCII touch a contraction."""
    said = ["Die imü erste. x", "éi'm here. y", "gonnaß z. w", "I'm gonna go. v", "_i'm i'm_ i'm1. u", "im. t"]
    spark.createDataFrame([(4 * i + 1, t, "de", "s", len(t)) for i, t in enumerate(said)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(4 * i + 1, 1, 0) for i in range(len(said))], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/l")
    for d, name in (("d", "documents"), ("l", "labels")):
        next((tmp_path / d).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    same(spark, queries()["translation_memory"], SQL["translation_memory"], str(tmp_path))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
