"""What users have or want is all that crates read."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from lattica.operators.crates import candidates, greedy
from lattica.plans import Catalog, OfUsers


def test_only_lines_of_users_releases_are_read(spark):
    c = Catalog(spark, "/root/testdata/sf0.001")
    near = OfUsers(c)
    of = c.collected.select("release_id").union(c.wanted.select("release_id")).distinct()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert 0 < near.lines.count() < c.lines.count()
    for edge in ("by", "on", "genres", "styles", "masters"):
        assert rows(getattr(near, edge)) == rows(getattr(c, edge).join(of, "release_id", "left_semi"))
    assert rows(near.collected) == rows(c.collected) and rows(near.wanted) == rows(c.wanted)
    some = lambda c: rows(candidates(c).where(F.col("user_id") % 5 == 0).select("user_id", "master_id", "release_id", F.concat_ws("|", "units")))
    assert some(near) == some(c)


def test_every_wanted_master_is_a_candidate(spark):
    """Among 251 wanted masters of one artist the last adds two others."""
    of = [(m, 1) for m in range(1, 252)] + [(251, 2), (251, 3)]
    table = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{k} bigint" for k in names))
    c = SimpleNamespace(
        collected=table([(8, 1)], ["user_id", "release_id"]), wanted=table([(7, m) for m in range(1, 252)], ["user_id", "release_id"]),
        by=table(of, ["release_id", "artist_id"]), masters=table([(m, m) for m in range(1, 252)], ["release_id", "master_id"]),
    )
    pool = candidates(c)
    assert pool.count() == 251
    assert [tuple(r) for r in greedy(pool).collect()] == [(7, "251", 3)]
