"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def _sortable(row):
    return tuple((x is None, str(x)) for x in row)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=_sortable)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, folder, name):
    result = QUERIES[name](spark, folder)
    got = _table(result.columns, result.collect())
    cursor = sql.execute(ORACLES[name])
    want = _table([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 4
