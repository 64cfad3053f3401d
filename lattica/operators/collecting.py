"""Collection pages, taste rows, fit evidence, ledger editions and evaluation of lists (sections 2.5, 2.10, 2.12 and 2.15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, scaled, top_n
from ..plans import Catalog, query
from .fit import _FACETS, bridges, matched  # noqa: F401
from .rarity import _SCORED, rarity_scores
from .similarity import first_releases

_PAGE = """WITH pg AS (SELECT * FROM (SELECT user_id, release_id, date_added, row_number() OVER (PARTITION BY user_id ORDER BY date_added DESC, release_id) AS place FROM {edges}) WHERE place <= 50),
    ids AS (SELECT DISTINCT release_id FROM pg), a AS (SELECT release_id, min(artist_id) AS artist FROM by_ GROUP BY 1), g AS (SELECT release_id, string_agg(genre, '|' ORDER BY genre) AS genres FROM genres GROUP BY 1), s AS (SELECT release_id, string_agg(style, '|' ORDER BY style) AS styles FROM styles GROUP BY 1)
    SELECT pg.user_id, pg.release_id, pg.place, r.year, r.label_id, a.artist, coalesce(g.genres, '') AS genres, coalesce(s.styles, '') AS styles FROM pg LEFT JOIN releases r USING (release_id) LEFT JOIN a USING (release_id) LEFT JOIN g USING (release_id) LEFT JOIN s USING (release_id)"""


def pages(c: Catalog, edges: DataFrame, limit: int = 50) -> DataFrame:
    """The newest of each user first, and only the releases of those pages are looked up (a semi-join before each grouping)."""
    page = top_n(edges.select("user_id", "release_id", "date_added"), ["user_id"], [F.desc("date_added"), "release_id"], limit, rank="place").drop("date_added")
    asked = page.select("release_id").distinct()
    only = lambda df: df.join(asked, "release_id", "left_semi")
    out = page.withColumn("place", F.col("place").cast("long")).join(c.releases.select("release_id", "year", "label_id"), "release_id", "left")
    out = out.join(only(c.by).groupBy("release_id").agg(F.min("artist_id").alias("artist")), "release_id", "left")
    for df, key in ((c.genres, "genre"), (c.styles, "style")):
        out = out.join(only(df).groupBy("release_id").agg(names(key).alias(f"{key}s")), "release_id", "left")
    return out.select("user_id", "release_id", "place", "year", "label_id", "artist", F.coalesce("genres", F.lit("")).alias("genres"), F.coalesce("styles", F.lit("")).alias("styles"))


@query("c1_collection_pages", _PAGE.format(edges="collected"))
def collection_pages(c: Catalog) -> DataFrame:
    return pages(c, c.collected)


@query("c1_wantlist_pages", _PAGE.format(edges="wanted"))
def wantlist_pages(c: Catalog) -> DataFrame:
    return pages(c, c.wanted)


@query("c5_taste_rows", """WITH e AS (SELECT user_id, release_id, 'COLLECTED' AS kind, date_added FROM collected UNION ALL SELECT user_id, release_id, 'WANTS', date_added FROM wanted), k AS (SELECT user_id, release_id, kind, count(*) AS edges, strftime(min(date_added), '%Y-%m-%d') AS first_day FROM e GROUP BY 1, 2, 3),
    my AS (SELECT master_id, min(year) AS master_year FROM masters JOIN releases USING (release_id) WHERE year > 0 GROUP BY 1), g AS (SELECT release_id, string_agg(genre, '|' ORDER BY genre) AS genres FROM genres GROUP BY 1), s AS (SELECT release_id, string_agg(style, '|' ORDER BY style) AS styles FROM styles GROUP BY 1)
    SELECT user_id, release_id, kind, edges, first_day, m.master_id, my.master_year, coalesce(genres, '') AS genres, coalesce(styles, '') AS styles FROM k LEFT JOIN masters m USING (release_id) LEFT JOIN my ON my.master_id = m.master_id LEFT JOIN g USING (release_id) LEFT JOIN s USING (release_id)""")
def taste_rows(c: Catalog) -> DataFrame:
    """A row for each (user, release, kind) with the lowest master and the facet sets."""
    edges = c.collected.select("user_id", "release_id", F.lit("COLLECTED").alias("kind"), "date_added").unionByName(c.wanted.select("user_id", "release_id", F.lit("WANTS").alias("kind"), "date_added"))
    rows = edges.groupBy("user_id", "release_id", "kind").agg(F.count("*").alias("edges"), F.date_format(F.min("date_added"), "yyyy-MM-dd").alias("first_day"))
    asked = rows.select("release_id").distinct()
    years = c.masters.join(c.releases.where("year > 0").select("release_id", "year"), "release_id").groupBy("master_id").agg(F.min("year").alias("master_year"))
    out = rows.join(c.masters, "release_id", "left").join(years, "master_id", "left")
    for df, key in ((c.genres, "genre"), (c.styles, "style")):
        out = out.join(df.join(asked, "release_id", "left_semi").groupBy("release_id").agg(names(key).alias(f"{key}s")), "release_id", "left")
    return out.select("user_id", "release_id", "kind", "edges", "first_day", "master_id", "master_year", F.coalesce("genres", F.lit("")).alias("genres"), F.coalesce("styles", F.lit("")).alias("styles"))


# fit


@query("c15_evidence", f"""{_FACETS}, t AS (SELECT user_id, release_id, dim, name, n, row_number() OVER (PARTITION BY user_id, release_id, n > 0 ORDER BY n DESC, dim, name) AS rn FROM m)
    SELECT user_id, release_id, coalesce(string_agg('shares ' || dim || ' ' || name || ' with ' || n || ' release' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' you hold', '; ' ORDER BY rn) FILTER (WHERE n > 0 AND rn <= 3), '') AS shared,
        coalesce(string_agg(name || ' is ' || CASE WHEN dim = 'artist' THEN 'an' ELSE 'a' END || ' ' || dim || ' your collection has never held', '; ' ORDER BY rn) FILTER (WHERE n = 0 AND rn <= 3), '') AS unheld, count(*) AS entries FROM t GROUP BY 1, 2""")
def evidence(c: Catalog, limit: int = 3) -> DataFrame:
    """The first sentences for what a wanted release shares with the collection and for what is new, and how many entries there are."""
    rows = matched(c).withColumn("new", F.col("n") == 0)
    place = F.row_number().over(Window.partitionBy("user_id", "release_id", "new").orderBy(F.desc("n"), "dim", "name"))
    # The sentences.
    shared = F.concat(F.lit("shares "), "dim", F.lit(" "), "name", F.lit(" with "), F.col("n").cast("string"), F.lit(" release"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(" you hold"))
    unheld = F.concat("name", F.lit(" is "), F.when(F.col("dim") == "artist", "an").otherwise("a"), F.lit(" "), "dim", F.lit(" your collection has never held"))
    rows = rows.withColumn("place", place).withColumn("said", F.when(F.col("new"), unheld).otherwise(shared))
    first = lambda new: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("new") == new) & (F.col("place") <= limit), F.struct("place", "said")))), lambda x: x["said"]), "; ")
    return rows.groupBy("user_id", "release_id").agg(first(F.lit(False)).alias("shared"), first(F.lit(True)).alias("unheld"), F.count("*").alias("entries"))


@query("c8_release_context", "SELECT r.release_id, r.year, r.label_id, m.master_id, count(DISTINCT b.artist_id) AS artists, count(DISTINCT g.genre) AS genres, count(DISTINCT s.style) AS styles FROM (SELECT DISTINCT release_id FROM wanted) w JOIN releases r USING (release_id) LEFT JOIN masters m USING (release_id) LEFT JOIN by_ b USING (release_id) LEFT JOIN genres g USING (release_id) LEFT JOIN styles s USING (release_id) GROUP BY 1, 2, 3, 4")
def release_context(c: Catalog) -> DataFrame:
    """What a fit reads of each wanted release; edges are counted each for itself, never multiplied."""
    asked = c.wanted.select("release_id").distinct()
    out = c.releases.join(asked, "release_id", "left_semi").select("release_id", "year", "label_id").join(c.masters, "release_id", "left")
    for df, name in ((c.by, "artists"), (c.genres, "genres"), (c.styles, "styles")):
        out = out.join(df.join(asked, "release_id", "left_semi").groupBy("release_id").agg(F.count("*").alias(name)), "release_id", "left")
    return out.fillna(0, ["artists", "genres", "styles"])


# gaps and second catalogs


@query("j5_filtered_gaps", """WITH held AS (SELECT DISTINCT user_id, release_id FROM collected), mine AS (SELECT DISTINCT user_id, label_id FROM held JOIN on_ USING (release_id)), ok AS (SELECT release_id FROM media GROUP BY 1 HAVING bool_or(family IN ('R') OR medium IN ('A_F')))
    SELECT m.label_id, m.user_id, count(*) AS missing FROM mine m JOIN on_ e USING (label_id) JOIN ok USING (release_id) WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.user_id = m.user_id AND h.release_id = e.release_id) GROUP BY 1, 2""")
def filtered_gaps(c: Catalog, families: tuple[str, ...] = ("R",), mediums: tuple[str, ...] = ("A_F",)) -> DataFrame:
    """Missing releases of each user's labels that come in one of the families or mediums. Totals less what is held: no user meets a label's releases."""
    fits = c.media.where(F.col("family").isin(*families) | F.col("medium").isin(*mediums)).select("release_id").distinct()
    edges = c.on.join(fits, "release_id", "left_semi")
    held = c.collected.select("user_id", "release_id").distinct()
    mine = held.join(c.on, "release_id").select("user_id", "label_id").distinct()
    total = edges.groupBy("label_id").agg(F.count("*").alias("total"))
    owned = held.join(edges, "release_id").groupBy("user_id", "label_id").agg(F.count("*").alias("owned"))
    out = mine.join(total, "label_id").join(owned, ["user_id", "label_id"], "left").fillna(0, ["owned"])
    return out.select("label_id", "user_id", (F.col("total") - F.col("owned")).alias("missing")).where("missing > 0")


@query("j8_second_catalog", """WITH cand AS (SELECT k AS release_id FROM ev WHERE event_type = 'signup' AND k IS NOT NULL UNION SELECT k FROM ev WHERE event_type = 'error' AND k IS NOT NULL), sib AS (SELECT label_id, year, min(master_id) AS m FROM releases JOIN masters USING (release_id) GROUP BY 1, 2 HAVING count(DISTINCT master_id) = 1)
    SELECT r.release_id, coalesce(m.master_id, sib.m) AS master_id, CASE WHEN m.master_id IS NOT NULL THEN 'native' WHEN sib.m IS NOT NULL THEN 'sibling' ELSE 'none' END AS attached FROM cand JOIN releases r USING (release_id) LEFT JOIN masters m USING (release_id) LEFT JOIN sib ON sib.label_id = r.label_id AND sib.year = r.year""")
def second_catalog(c: Catalog) -> DataFrame:
    """Releases that two feeds name, attached to their master: the native one, else that of their siblings if they have one only."""
    feed = lambda kind: c.events.where((F.col("event_type") == kind) & F.col("k").isNotNull()).select(F.col("k").alias("release_id"))
    asked = feed("signup").union(feed("error")).distinct()
    known = c.releases.select("release_id", "label_id", "year")
    ends = known.join(c.masters, "release_id").groupBy("label_id", "year").agg(F.min("master_id").alias("one"), F.max("master_id").alias("other")).where("one = other").select("label_id", "year", F.col("one").alias("sibling"))
    rows = known.join(asked, "release_id", "left_semi").join(c.masters, "release_id", "left").join(ends, ["label_id", "year"], "left")
    how = F.when(F.col("master_id").isNotNull(), "native").when(F.col("sibling").isNotNull(), "sibling").otherwise("none")
    return rows.select("release_id", F.coalesce("master_id", "sibling").alias("master_id"), how.alias("attached"))


@query("j11_sparse_credits", "SELECT r.release_id, r.year, o.artist_id AS other FROM releases r JOIN (SELECT release_id, count(*) AS n, max(artist_id) AS artist_id FROM by_ GROUP BY 1 HAVING count(*) <= 2) o USING (release_id) ORDER BY r.year DESC, r.release_id LIMIT 200")
def sparse_credits(c: Catalog, limit: int = 200) -> DataFrame:
    """A bounded page of releases with at most one other credit, newest first."""
    few = c.by.groupBy("release_id").agg(F.count("*").alias("n"), F.max("artist_id").alias("other")).where("n <= 2")
    return c.releases.select("release_id", "year").join(few, "release_id").orderBy(F.desc("year"), "release_id").limit(limit).select("release_id", "year", "other")


_LATEST = "l AS (SELECT event_type, user_id, max_by(k, (ts, event_id)) AS k FROM ev WHERE event_type IN ('signup', 'error', 'view') GROUP BY 1, 2)"


def latest(c: Catalog, kind: str, name: str) -> DataFrame:
    return c.events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max_by("k", F.struct("ts", "event_id")).alias(name))


@query("j14_linked", f"WITH {_LATEST} SELECT u.user_id, a.k AS linked, b.k AS candidate FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN l a ON a.user_id = u.user_id AND a.event_type = 'signup' LEFT JOIN l b ON b.user_id = u.user_id AND b.event_type = 'error' WHERE a.k IS DISTINCT FROM b.k")
def linked(c: Catalog) -> DataFrame:
    """Current link and current candidate of each user, where they differ (null is a value)."""
    users = c.events.select("user_id").distinct()
    return users.join(latest(c, "signup", "linked"), "user_id", "left").join(latest(c, "error", "candidate"), "user_id", "left").where(~F.col("linked").eqNullSafe(F.col("candidate")))


@query("j15_link_census", f"""WITH {_LATEST}, c AS (SELECT u.user_id, a.k AS linked, b.k AS candidate FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN l a ON a.user_id = u.user_id AND a.event_type = 'signup' LEFT JOIN l b ON b.user_id = u.user_id AND b.event_type = 'error' WHERE a.k IS DISTINCT FROM b.k)
    SELECT count(*) AS candidates, count(*) FILTER (WHERE linked IS NULL) AS unlinked, count(*) FILTER (WHERE candidate IN (SELECT k FROM collected_k)) AS held_elsewhere, count(*) FILTER (WHERE candidate IN (SELECT linked FROM c WHERE linked IS NOT NULL)) AS taken FROM c""".replace("collected_k", "(SELECT release_id AS k FROM collected)"))
def link_census(c: Catalog) -> DataFrame:
    """How many candidates each guard stops; guards are joined as key sets."""
    rows = linked(c)
    held = c.collected.select(F.col("release_id").alias("candidate")).distinct().withColumn("held", F.lit(True))
    taken = rows.where("linked is not null").select(F.col("linked").alias("candidate")).distinct().withColumn("taken", F.lit(True))
    rows = rows.join(held, "candidate", "left").join(taken, "candidate", "left")
    return rows.agg(F.count("*").alias("candidates"), F.count_if(F.col("linked").isNull()).alias("unlinked"), F.count("held").alias("held_elsewhere"), F.count("taken").alias("taken"))


# ledger


@query("i2_work_editions", "SELECT work, release_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS first_seen FROM (SELECT l_partkey AS work, l_orderkey AS release_id FROM lineitem UNION SELECT master_id, release_id FROM masters) w JOIN ev ON ev.k = w.release_id GROUP BY 1, 2")
def work_editions(c: Catalog) -> DataFrame:
    """Editions of each work over two catalogs, with the first instant that an event names them."""
    members = c.lines.select(F.col("l_partkey").alias("work"), F.col("l_orderkey").alias("release_id")).union(c.masters.select("master_id", "release_id")).distinct()
    seen = c.events.where("k is not null").groupBy(F.col("k").alias("release_id")).agg(F.min("ts").alias("at"))
    return members.join(seen, "release_id").select("work", "release_id", F.date_format("at", "yyyy-MM-dd HH:mm").alias("first_seen"))


@query("i3_shared_editions", "WITH p AS (SELECT DISTINCT l_partkey AS work, l_orderkey AS release_id FROM lineitem), n AS (SELECT release_id, count(*) AS works FROM p GROUP BY 1) SELECT work, count(*) AS editions, count(*) FILTER (WHERE works > 1) AS shared FROM p JOIN n USING (release_id) GROUP BY 1")
def shared_editions(c: Catalog) -> DataFrame:
    """Editions of each work, and those that belong to several works."""
    pairs = c.lines.select(F.col("l_partkey").alias("work"), F.col("l_orderkey").alias("release_id")).distinct()
    works = pairs.groupBy("release_id").agg(F.count("*").alias("works"))
    return pairs.join(works, "release_id").groupBy("work").agg(F.count("*").alias("editions"), F.count_if(F.col("works") > 1).alias("shared"))


# evaluation


_LISTS = """WITH tr AS (SELECT DISTINCT user_id, release_id FROM collected WHERE date_added < TIMESTAMP '2024-01-20 00:00:00'), te AS (SELECT DISTINCT user_id, release_id FROM collected WHERE date_added >= TIMESTAMP '2024-01-20 00:00:00' EXCEPT SELECT * FROM tr),
    lb AS (SELECT user_id, label_id, count(*) AS n FROM tr JOIN on_ USING (release_id) GROUP BY 1, 2), rk AS (SELECT user_id, release_id, rn FROM (SELECT lb.user_id, o.release_id, row_number() OVER (PARTITION BY lb.user_id ORDER BY n DESC, o.release_id) AS rn FROM lb JOIN on_ o USING (label_id) WHERE (lb.user_id, o.release_id) NOT IN (SELECT user_id, release_id FROM tr)) WHERE rn <= 20)"""


def label_lists(c: Catalog, cut: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(held out, lists with ranks) of the label heuristic over a split in time.

    The best k lie among the first k + h unheld releases of each liked label, so a user meets that many of a label, however many it has.
    """
    keys = ["user_id", "release_id"]
    at = F.lit(cut).cast("timestamp_ntz")
    train = c.collected.where(F.col("date_added") < at).select(*keys).distinct()
    test = c.collected.where(F.col("date_added") >= at).select(*keys).distinct().join(train, keys, "left_anti")
    liked = train.join(c.on, "release_id").groupBy("user_id", "label_id").agg(F.count("*").alias("n"))
    rows = first_releases(c.on, "label_id", liked, train, k).join(train, keys, "left_anti")
    return test, top_n(rows.select(*keys, "n"), ["user_id"], [F.desc("n"), "release_id"], k, rank="rn")


@query("v5_recommendation_metrics", f"""{_LISTS}, h AS (SELECT te.user_id, rn FROM te JOIN rk ON te.user_id = rk.user_id AND te.release_id = rk.release_id), u AS (SELECT user_id, count(*) AS n FROM te GROUP BY 1), p AS (SELECT u.user_id, u.n, count(h.rn) AS hits, coalesce(sum(1 / log2(h.rn + 1)), 0) AS dcg, coalesce(max(1.0::DOUBLE / h.rn), 0) AS rr FROM u LEFT JOIN h USING (user_id) GROUP BY 1, 2),
    ideal AS (SELECT i, sum(1 / log2(j + 1)) AS best FROM range(1, 21) a(i) JOIN range(1, 21) b(j) ON j <= i GROUP BY 1)
    SELECT count(*) AS users, CAST(floor(round(avg(hits / 20), 9) * 1e6 + 0.5) AS BIGINT) AS precision_ppm, CAST(floor(round(avg(hits / n), 9) * 1e6 + 0.5) AS BIGINT) AS recall_ppm, CAST(floor(round(avg(dcg / best), 9) * 1e6 + 0.5) AS BIGINT) AS ndcg_ppm, CAST(floor(round(avg(rr), 9) * 1e6 + 0.5) AS BIGINT) AS mrr_ppm, CAST(floor(round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 9) * 1e6 + 0.5) AS BIGINT) AS hit_rate_ppm FROM p JOIN ideal ON i = least(20, n)""")
def recommendation_metrics(c: Catalog, cut: str = "2024-01-20", k: int = 20) -> DataFrame:
    """Means over users of precision, recall, NDCG, reciprocal rank and hit rate at k."""
    test, lists = label_lists(c, cut, k)
    hits = test.join(lists, ["user_id", "release_id"])
    per = test.groupBy("user_id").agg(F.count("*").alias("n")).join(hits.groupBy("user_id").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rn") + 1)).alias("dcg"), F.max(1 / F.col("rn")).alias("rr")), "user_id", "left").fillna(0)
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n")).cast("int")), F.lit(0.0), lambda a, j: a + 1 / F.log2(j + 1))
    mean = lambda x, name: scaled(F.round(F.avg(x), 9)).alias(name)
    return per.agg(F.count("*").alias("users"), mean(F.col("hits") / k, "precision_ppm"), mean(F.col("hits") / F.col("n"), "recall_ppm"), mean(F.col("dcg") / best, "ndcg_ppm"), mean(F.col("rr"), "mrr_ppm"), mean((F.col("hits") > 0).cast("int"), "hit_rate_ppm"))


@query("v7_rarity_metrics", f"""{_SCORED}, cc AS (SELECT release_id, count(DISTINCT user_id) AS n FROM collected GROUP BY 1) SELECT tier, count(*) AS n, CAST(floor(count(*) / sum(count(*)) OVER () * 1e6 + 0.5) AS BIGINT) AS share_ppm, CAST(floor(round(avg(score), 6) * 100 + 0.5) AS BIGINT) AS mean_score, CAST(floor(round(avg(coalesce(cc.n, 0)), 9) * 1e6 + 0.5) AS BIGINT) AS collectors_ppm FROM rated LEFT JOIN cc USING (release_id) GROUP BY 1""")
def rarity_metrics(c: Catalog) -> DataFrame:
    """Tiers with their shares, mean scores and mean numbers of collectors."""
    counts = c.collected.groupBy("release_id").agg(F.count_distinct("user_id").alias("c"))
    rows = rarity_scores(c).join(counts, "release_id", "left").groupBy("tier").agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg(F.coalesce("c", F.lit(0))).alias("k"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return rows.select("tier", "n", scaled(share).alias("share_ppm"), scaled(F.round("s", 6), 2).alias("mean_score"), scaled(F.round("k", 9)).alias("collectors_ppm"))


@query("z20_observed_holdings", "SELECT user_id, count(DISTINCT release_id) FILTER (WHERE date_added < TIMESTAMP '2024-01-20 00:00:00') AS observed, count(DISTINCT release_id) FILTER (WHERE date_added >= TIMESTAMP '2024-01-20 00:00:00') AS later FROM collected GROUP BY 1")
def observed_holdings(c: Catalog, cut: str = "2024-01-20") -> DataFrame:
    before = F.col("date_added") < F.lit(cut).cast("timestamp_ntz")
    return c.collected.groupBy("user_id").agg(F.count_distinct(F.when(before, F.col("release_id"))).alias("observed"), F.count_distinct(F.when(~before, F.col("release_id"))).alias("later"))


@query("x11_sync_collection", "WITH a AS (SELECT DISTINCT user_id, release_id FROM collected WHERE date_added < TIMESTAMP '2024-01-20 00:00:00'), b AS (SELECT DISTINCT user_id, release_id FROM collected WHERE value >= 5) SELECT user_id, release_id, CASE WHEN a.release_id IS NULL THEN 'added' WHEN b.release_id IS NULL THEN 'swept' ELSE 'kept' END AS state FROM a FULL OUTER JOIN b USING (user_id, release_id)".replace("a.release_id IS NULL", "a.user_id IS NULL").replace("b.release_id IS NULL", "b.user_id IS NULL"))
def synced_collection(c: Catalog, cut: str = "2024-01-20") -> DataFrame:
    """Mark and sweep: the stored copy against all fetched pages; what no page shows is swept."""
    keys = ["user_id", "release_id"]
    stored = c.collected.where(F.col("date_added") < F.lit(cut).cast("timestamp_ntz")).select(*keys).distinct().withColumn("s", F.lit(True))
    pages_ = c.collected.where("value >= 5").select(*keys).distinct().withColumn("p", F.lit(True))
    return stored.join(pages_, keys, "full_outer").select(*keys, F.when(F.col("s").isNull(), "added").when(F.col("p").isNull(), "swept").otherwise("kept").alias("state"))


@query("x7_recorded_outcomes", "SELECT user_id, k, event_type AS outcome, min(event_id) AS event_id, count(*) - 1 AS repeats FROM ev WHERE event_type IN ('purchase', 'click') AND k IS NOT NULL GROUP BY 1, 2, 3")
def recorded_outcomes(c: Catalog) -> DataFrame:
    """An append that repeats change nothing in: the first of each (user, item, outcome) stands."""
    rows = c.events.where(F.col("event_type").isin("purchase", "click") & F.col("k").isNotNull()).groupBy("user_id", "k", F.col("event_type").alias("outcome"))
    return rows.agg(F.min("event_id").alias("event_id"), (F.count("*") - 1).alias("repeats"))


@query("s21_export_lines", """SELECT 'collection' AS section, '{"user_id":' || user_id || ',"release_id":' || release_id || '}' AS line FROM collected WHERE release_id IS NOT NULL UNION ALL SELECT 'wants', '{"user_id":' || user_id || ',"release_id":' || release_id || '}' FROM wanted WHERE release_id IS NOT NULL""")
def export_lines(c: Catalog) -> DataFrame:
    """The export itself: a JSON line for each row of each section."""
    one = lambda df, name: df.where("release_id is not null").select(F.lit(name).alias("section"), F.to_json(F.struct("user_id", "release_id")).alias("line"))
    return one(c.collected, "collection").unionByName(one(c.wanted, "wants"))
