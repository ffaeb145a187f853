"""Queries with SQL against DuckDB on the smallest tables; the rest against rules."""

import duckdb
import pytest

from kerfwork.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_chains_are_contiguous(spark):
    from kerfwork.operators import segments
    from kerfwork.plans.views import view

    alone = segments.survivors(view(spark, SF, "seg"))
    rows = segments.chain(alone)
    assert rows.count() == rows.select("drawing_id", "seg_id").distinct().count() == alone.count()
    pdf = rows.join(alone, ["drawing_id", "seg_id"]).toPandas().sort_values(["drawing_id", "contour_id", "seg_ord"])
    for _, g in pdf.groupby(["drawing_id", "contour_id"]):
        ends = [((r.ex, r.ey), (r.sx, r.sy)) if r.reversed else ((r.sx, r.sy), (r.ex, r.ey)) for r in g.itertuples()]
        assert all(a[1] == b[0] for a, b in zip(ends[:-1], ends[1:], strict=True))
