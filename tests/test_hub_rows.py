"""Rows that hubs are made of: titles are numbered in their order, and edges of a release meet once."""

from lattica.operators.discover import hub_rows
from lattica.plans import Catalog


def test_titles_are_numbered_in_their_order(spark):
    c = Catalog(spark, "/root/testdata/sf0.001")
    near = hub_rows(c)
    titles = [r["title"] for r in near.names.orderBy("title_no").collect()]
    assert titles == sorted({r["p_name"] for r in c.table("part").collect()})
    assert near.releases.count() == c.genres.select("release_id").distinct().count()
    assert near.releases.selectExpr("sum(size(artist_ids))").first()[0] == c.by.join(c.genres.select("release_id").distinct(), "release_id").count()
