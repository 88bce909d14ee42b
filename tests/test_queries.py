"""Every archive query that has SQL gives the SQL's rows."""

import pytest

from heddle.plans import archive

from .conftest import SF


def rows(found):
    return sorted(tuple("null" if v is None else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(archive.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    df = archive.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*cols).collect())
    names = ", ".join(f'"{c}"' for c in cols)
    assert got == rows(duck.execute(f"SELECT {names} FROM ({archive.oracle_sql()[name]})").fetchall())


def test_others_give_rows(spark):
    for name in sorted(set(archive.queries()) - set(archive.oracle_sql()) - {"c12_purge_plan", "c13_compacted_rows"}):
        assert archive.queries()[name](spark, SF).count() > 0, name
