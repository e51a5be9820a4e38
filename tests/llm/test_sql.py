import pytest

from fragmill.llm.queries import ORACLES, QUERIES
from tests.test_oracles import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):  # noqa: F811
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(sql.columns, sql.fetchall())
    assert got == want and want
