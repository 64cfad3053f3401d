"""Aliases over time, supersession and the identity ledger (section 2.12), and windows (section 2.17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import top_n
from ..plans import Catalog, query, shared_dir


def validity(events: DataFrame, key: list[str], at: str, order: str) -> DataFrame:
    """One row for each version: valid from its own instant to the next one of its key; the last is open."""
    return events.withColumn("valid_to", F.lead(at).over(Window.partitionBy(*key).orderBy(at, order))).withColumnRenamed(at, "valid_from")


def aliases_over_time(c: Catalog) -> DataFrame:
    return validity(c.events.select("event_type", "k", "user_id", "ts", "event_id"), ["event_type", "k"], "ts", "event_id")


_ALIASES = "WITH al AS (SELECT event_type, k, user_id, event_id, ts AS valid_from, lead(ts) OVER (PARTITION BY event_type, k ORDER BY ts, event_id) AS valid_to FROM ev)"


@query("l1_current_aliases", f"{_ALIASES} SELECT event_type, k, user_id FROM al WHERE valid_to IS NULL")
def current_aliases(c: Catalog) -> DataFrame:
    """The open row of each key is its last one: an aggregate finds it without the window."""
    last = c.events.groupBy("event_type", "k").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("user_id"))
    return last.select("event_type", "k", "user_id")


@query("l2_batch_aliases", f"{_ALIASES} SELECT p.p_partkey, al.user_id FROM part p JOIN al ON al.k = p.p_size AND al.event_type = 'signup' AND al.valid_to IS NULL")
def batch_aliases(c: Catalog) -> DataFrame:
    """Many keys at once; keys without an open alias are dropped."""
    open_ = current_aliases(c).where("event_type = 'signup'").select("k", "user_id")
    return c.table("part").select("p_partkey", F.col("p_size").cast("long").alias("k")).join(open_, "k").select("p_partkey", "user_id")


@query("i8_state_as_of", f"""{_ALIASES} SELECT k, bool_or(event_type = 'purchase') AS linked, bool_or(event_type = 'error') AS failed, count(*) AS open_rows,
    CASE WHEN bool_or(event_type = 'purchase') AND bool_or(event_type = 'error') THEN 'split' WHEN bool_or(event_type = 'purchase') THEN 'linked' ELSE 'unresolved' END AS state
    FROM al WHERE valid_from <= TIMESTAMP '2024-01-03 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-03 12:00:00') GROUP BY 1""")
def state_as_of(c: Catalog, at: str = "2024-01-03 12:00:00") -> DataFrame:
    t = F.lit(at).cast("timestamp_ntz")
    rows = aliases_over_time(c).where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
    out = rows.groupBy("k").agg(F.bool_or(F.col("event_type") == "purchase").alias("linked"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.count("*").alias("open_rows"))
    return out.withColumn("state", F.when(F.col("linked") & F.col("failed"), "split").when(F.col("linked"), "linked").otherwise("unresolved"))


@query("i10_holder_as_of", f"{_ALIASES} SELECT e.event_id, al.user_id AS holder FROM ev e JOIN al ON al.k = e.k AND al.event_type = 'signup' AND al.valid_from <= e.ts AND (al.valid_to IS NULL OR al.valid_to > e.ts) WHERE e.event_type = 'view'")
def holder_as_of(c: Catalog) -> DataFrame:
    """As-of join by one window over both sides of a key, instead of a range join of all versions with all events."""
    views = c.events.where("event_type = 'view'").select("k", "ts", F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("user_id"))
    holds = c.events.where("event_type = 'signup'").select("k", "ts", F.lit(0).alias("side"), "event_id", "user_id")
    order = Window.partitionBy("k").orderBy("ts", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = holds.unionByName(views).withColumn("holder", F.last("user_id", ignorenulls=True).over(order))
    return rows.where("side = 1 and holder is not null").select("event_id", "holder")


@query("i1_resolved_documents", "WITH s AS (SELECT text, min(doc_id) AS survivor FROM documents GROUP BY 1) SELECT d.doc_id, s.survivor, d.doc_id <> s.survivor AS superseded FROM documents d JOIN s ON d.text = s.text")
def resolved_documents(c: Catalog) -> DataFrame:
    """One hop to the survivor: the least id of equal texts. Texts are shuffled as 256-bit digests."""
    rows = c.table("documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("survivor"))
    return rows.join(least, "digest").select("doc_id", "survivor", (F.col("doc_id") != F.col("survivor")).alias("superseded"))


@query("i4_ledger_works", "SELECT k, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS repaired, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM ev GROUP BY 1")
def ledger_works(c: Catalog) -> DataFrame:
    return c.events.groupBy("k").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("repaired"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("i5_neighbour_events", "SELECT event_id, lag(event_id) OVER w AS prev_id, lead(event_id) OVER w AS next_id FROM ev WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)")
def neighbour_events(c: Catalog) -> DataFrame:
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    return c.events.select("event_id", F.lag("event_id").over(w).alias("prev_id"), F.lead("event_id").over(w).alias("next_id"))


@query("i6_window_facts", "SELECT k, min(event_id) AS first_id, max(event_id) AS last_id FROM ev WHERE event_type = 'purchase' GROUP BY 1")
def window_facts(c: Catalog) -> DataFrame:
    return c.events.where("event_type = 'purchase'").groupBy("k").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("i9_minted_and_linked", """WITH f AS (SELECT k, min(event_id) AS minted FROM ev GROUP BY 1) SELECT f.k, f.minted, min(e.event_id) AS linked FROM f LEFT JOIN ev e ON e.k = f.k AND e.event_type = 'purchase' AND e.event_id > f.minted GROUP BY 1, 2""")
def minted_and_linked(c: Catalog) -> DataFrame:
    """First event of an item and its first purchase after that."""
    first = F.min("event_id").over(Window.partitionBy("k"))
    rows = c.events.select("k", "event_id", "event_type", first.alias("minted"))
    linked = F.min(F.when((F.col("event_type") == "purchase") & (F.col("event_id") > F.col("minted")), F.col("event_id")))
    return rows.groupBy("k", "minted").agg(linked.alias("linked"))


@query("i16_suffix_minimum", "SELECT event_id, min(CAST(value * 100 + 0.5 AS BIGINT)) OVER (PARTITION BY k ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bound FROM ev".replace("CAST(value * 100 + 0.5 AS BIGINT)", "CAST(floor(value * 100 + 0.5) AS BIGINT)"))
def suffix_minimum(c: Catalog) -> DataFrame:
    # From the end on: a frame that only grows takes one step a row, one that begins at the row is summed up anew for each.
    w = Window.partitionBy("k").orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    return c.events.select("event_id", F.min(F.floor(F.col("value") * 100 + 0.5).cast("long")).over(w).alias("bound"))


@query("i14_census", f"""{_ALIASES} SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE valid_to IS NULL) AS current, count(DISTINCT k) AS keys, count(DISTINCT user_id) FILTER (WHERE valid_to IS NULL) AS holders FROM al GROUP BY 1""")
def census(c: Catalog) -> DataFrame:
    open_ = F.col("valid_to").isNull()
    return aliases_over_time(c).groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if(open_).alias("current"), F.count_distinct("k").alias("keys"), F.count_distinct(F.when(open_, F.col("user_id"))).alias("holders"))


@query("w3_first_row_per_key", "SELECT k, event_id FROM (SELECT k, event_id, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS rn FROM ev) WHERE rn = 1")
def first_row_per_key(c: Catalog) -> DataFrame:
    return c.events.groupBy("k").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("w13_page_and_total", "SELECT event_id, total FROM (SELECT event_id, count(*) OVER () AS total FROM ev WHERE event_type = 'view') ORDER BY event_id LIMIT 100")
def page_and_total(c: Catalog) -> DataFrame:
    """A page and the exact total from two aggregates, not a window over all rows."""
    rows = c.events.where("event_type = 'view'").select("event_id")
    return rows.orderBy("event_id").limit(100).join(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("w7_average_ranks", "SELECT artist_id, CAST(floor((rank() OVER (PARTITION BY nation ORDER BY n) + (count(*) OVER (PARTITION BY nation, n) - 1) / 2) * 2 + 0.5) AS BIGINT) AS twice_rank FROM (SELECT a.artist_id, nation, count(*) AS n FROM artists a JOIN by_raw b ON a.artist_id = b.artist_id GROUP BY 1, 2)")
def average_ranks(c: Catalog) -> DataFrame:
    n = c.by_raw.join(c.artists.select("artist_id", "nation"), "artist_id").groupBy("artist_id", "nation").agg(F.count("*").alias("n"))
    rank = F.rank().over(Window.partitionBy("nation").orderBy("n")) * 2 + F.count("*").over(Window.partitionBy("nation", "n")) - 1
    return n.select("artist_id", rank.cast("long").alias("twice_rank"))


@query("w11_max_normalised", "SELECT artist_id, CAST(floor(n / max(n) OVER (PARTITION BY nation) * 1e6 + 0.5) AS BIGINT) AS share_ppm FROM (SELECT a.artist_id, nation, count(*) AS n FROM artists a JOIN by_raw b ON a.artist_id = b.artist_id GROUP BY 1, 2)")
def max_normalised(c: Catalog) -> DataFrame:
    n = c.by_raw.join(c.artists.select("artist_id", "nation"), "artist_id").groupBy("artist_id", "nation").agg(F.count("*").alias("n"))
    return n.select("artist_id", F.floor(F.col("n") / F.max("n").over(Window.partitionBy("nation")) * 10**6 + 0.5).cast("long").alias("share_ppm"))


@query("w14_member_pages", "SELECT label_id, release_id, (row_number() OVER (PARTITION BY label_id ORDER BY release_id) - 1) // 8 AS page FROM on_")
def member_pages(c: Catalog, size: int = 8) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("label_id").orderBy("release_id"))
    return c.on.select("label_id", "release_id", F.floor((number - 1) / size).cast("long").alias("page"))


# supersession: functional rewrites of alias tables


def merge_items(supersessions: DataFrame, rounds: int = 32) -> DataFrame:
    """(superseded, survivor) chains compressed to one hop by pointer doubling."""
    hops = supersessions.select("superseded", "survivor").distinct()
    for _ in range(rounds):
        nxt = hops.select(F.col("superseded").alias("__s"), F.col("survivor").alias("__n"))
        longer = hops.join(nxt, F.col("survivor") == F.col("__s"), "left")
        moved = longer.select("superseded", F.coalesce("__n", "survivor").alias("survivor"), F.col("__n").isNotNull().alias("moved")).checkpoint()
        if moved.where("moved").isEmpty():
            return moved.select("superseded", "survivor")
        hops = moved.select("superseded", "survivor")
    raise ValueError("supersessions form a cycle")


def reattach(aliases: DataFrame, supersessions: DataFrame, at: str) -> DataFrame:
    """Close open aliases of superseded items at one instant and reopen them on the survivor; a value that the survivor holds stays closed."""
    t = F.lit(at).cast("timestamp_ntz")
    open_ = aliases.where("valid_to is null")
    moving = open_.join(supersessions, F.col("native_id") == F.col("superseded"))
    key = ["provider", "external_id"]
    held = open_.select(*key, F.col("native_id").alias("survivor")).distinct()
    fresh = moving.join(held, [*key, "survivor"], "left_anti").select(*key, F.col("survivor").alias("native_id"), t.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to")).distinct()
    gone = F.col("superseded").isNotNull() & F.col("valid_to").isNull()
    closed = aliases.join(supersessions, F.col("native_id") == F.col("superseded"), "left").select(*key, "native_id", "valid_from", F.when(gone, t).otherwise(F.col("valid_to")).alias("valid_to"))
    return closed.unionByName(fresh)


@query("i12_superseded_documents", "SELECT d.doc_id AS superseded, s.survivor FROM documents d JOIN (SELECT text, min(doc_id) AS survivor FROM documents GROUP BY 1) s ON d.text = s.text WHERE d.doc_id <> s.survivor")
def superseded_documents(c: Catalog) -> DataFrame:
    """Each copy points to the one before it; compression leads all to the first."""
    rows = c.table("documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    before = F.lag("doc_id").over(Window.partitionBy("digest").orderBy("doc_id"))
    links = rows.select(F.col("doc_id").alias("superseded"), before.alias("survivor")).where("survivor is not null")
    ensure_checkpoints(c)
    return merge_items(links)


def ensure_checkpoints(c: Catalog) -> None:
    """Loops cut lineage in the folder that driver and executors share."""
    sc = c.spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(c.spark))


# paths


def shortest_paths(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, node, distance): breadth-first levels from all sources at once over undirected edges (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = frontier = sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("distance"))
    for d in range(1, depth + 1):
        step = frontier.join(both, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct()
        frontier = step.join(seen, ["source", "node"], "left_anti").withColumn("distance", F.lit(d).cast("long")).checkpoint()
        seen = seen.unionByName(frontier)
    return seen


def alias_distances(c: Catalog, sources: str | None = None, depth: int = 6) -> DataFrame:
    """Artists within ``depth`` (1 to 10) alias hops of all artists; ``sources`` is a condition on the ``artist_id`` of the source."""
    if not 1 <= depth <= 10:
        raise ValueError("depth must be from 1 to 10")
    ensure_checkpoints(c)
    start = c.artists.where(sources) if sources else c.artists
    return shortest_paths(c.aliases.select(F.col("artist_id").alias("a"), F.col("other_id").alias("b")), start.select(F.col("artist_id").alias("source")), depth)


@query("p1_alias_distances", """WITH RECURSIVE e AS (SELECT artist_id AS a, other_id AS b FROM aliases UNION SELECT other_id, artist_id FROM aliases),
    w AS (SELECT artist_id AS source, artist_id AS node, CAST(0 AS BIGINT) AS distance FROM artists WHERE artist_id % 100 = 0 UNION SELECT source, b, distance + 1 FROM w JOIN e ON node = a WHERE distance < 6) SELECT source, node, min(distance) AS distance FROM w GROUP BY 1, 2""".replace("WITH RECURSIVE e", "WITH e"))
def asked_alias_distances(c: Catalog) -> DataFrame:
    """The query set: sources whose ids are divisible by 100, against all artists."""
    return alias_distances(c, "artist_id % 100 = 0")


@query("p1_alias_distances_all", """WITH e AS (SELECT artist_id AS a, other_id AS b FROM aliases UNION SELECT other_id, artist_id FROM aliases),
    w AS (SELECT artist_id AS source, artist_id AS node, CAST(0 AS BIGINT) AS distance FROM artists UNION SELECT source, b, distance + 1 FROM w JOIN e ON node = a WHERE distance < 6) SELECT source, node, min(distance) AS distance FROM w GROUP BY 1, 2""")
def all_alias_distances(c: Catalog) -> DataFrame:
    return alias_distances(c)


@query("m12_explore_traversal", """WITH d1 AS (SELECT g.genre, b.artist_id, CAST(1 AS BIGINT) AS distance FROM genres g JOIN by_ b USING (release_id) GROUP BY 1, 2), d2 AS (SELECT d.genre, o.label_id, count(DISTINCT d.artist_id) AS artists FROM d1 d JOIN by_ b ON d.artist_id = b.artist_id JOIN on_ o ON b.release_id = o.release_id GROUP BY 1, 2)
    SELECT genre, label_id, artists FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY artists DESC, label_id) AS rn FROM d2) WHERE rn <= 100""")
def explore_traversal(c: Catalog, n: int = 100) -> DataFrame:
    """Labels two hops from a genre over its artists, the best connected first."""
    near = c.genres.join(c.by, "release_id").select("genre", "artist_id").distinct()
    pairs = c.by.join(c.on, "release_id").select("artist_id", "label_id").distinct()
    far = near.join(pairs, "artist_id").groupBy("genre", "label_id").agg(F.count("*").alias("artists"))
    return top_n(far, ["genre"], [F.desc("artists"), "label_id"], n)


@query("b1_strata_ladder", """SELECT r.release_id, r.year, m.master_id, my.y AS master_year, coalesce(a.x, '') AS credits FROM releases r LEFT JOIN masters m USING (release_id) LEFT JOIN (SELECT master_id, min(year) AS y FROM masters JOIN releases USING (release_id) WHERE year > 0 GROUP BY 1) my ON m.master_id = my.master_id
    LEFT JOIN (SELECT release_id, string_agg(CAST(artist_id AS VARCHAR), '|' ORDER BY artist_id) AS x FROM by_ GROUP BY 1) a ON r.release_id = a.release_id""")
def strata_ladder(c: Catalog) -> DataFrame:
    years = c.masters.join(c.releases.where("year > 0"), "release_id").groupBy("master_id").agg(F.min("year").alias("master_year"))
    credit = c.by_raw.groupBy("release_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("artist_id")), lambda x: x.cast("string")), "|").alias("credits"))
    return c.releases.select("release_id", "year").join(c.masters, "release_id", "left").join(years, "master_id", "left").join(credit, "release_id", "left").select("release_id", "year", "master_id", "master_year", F.coalesce("credits", F.lit("")).alias("credits"))


@query("b9_scope_units", """WITH o AS (SELECT DISTINCT user_id, master_id FROM collected c JOIN masters m ON c.release_id = m.release_id), u AS (SELECT DISTINCT user_id, label_id FROM collected c JOIN on_ o ON c.release_id = o.release_id),
    t AS (SELECT label_id, count(DISTINCT master_id) AS units FROM on_ JOIN masters USING (release_id) GROUP BY 1), h AS (SELECT o.user_id, l.label_id, count(DISTINCT o.master_id) AS owned FROM o JOIN (SELECT DISTINCT label_id, master_id FROM on_ JOIN masters USING (release_id)) l ON o.master_id = l.master_id GROUP BY 1, 2)
    SELECT u.user_id, u.label_id, units, coalesce(owned, 0) AS owned, units - coalesce(owned, 0) AS missing FROM u JOIN t ON u.label_id = t.label_id LEFT JOIN h ON h.user_id = u.user_id AND h.label_id = u.label_id""")
def scope_units(c: Catalog) -> DataFrame:
    """Works of each held label that the user owns in any edition, and those missing."""
    works = c.on.join(c.masters, "release_id").select("label_id", "master_id").distinct()
    held = c.collected.select("user_id", "release_id").distinct()
    owned = held.join(c.masters, "release_id").select("user_id", "master_id").distinct().join(works, "master_id").groupBy("user_id", "label_id").agg(F.count("*").alias("owned"))
    units = works.groupBy("label_id").agg(F.count("*").alias("units"))
    out = held.join(c.on, "release_id").select("user_id", "label_id").distinct().join(units, "label_id").join(owned, ["user_id", "label_id"], "left").fillna(0, ["owned"])
    return out.withColumn("missing", F.col("units") - F.col("owned"))


@query("b10_confirmed_editions", "SELECT user_id, master_id, count(DISTINCT c.release_id) AS editions, count(DISTINCT c.release_id) = 1 AS confirmed FROM collected c JOIN masters m ON c.release_id = m.release_id GROUP BY 1, 2")
def confirmed_editions(c: Catalog) -> DataFrame:
    rows = c.collected.select("user_id", "release_id").distinct().join(c.masters, "release_id").groupBy("user_id", "master_id").agg(F.count("*").alias("editions"))
    return rows.withColumn("confirmed", F.col("editions") == 1)


# evaluation (section 2.15)


@query("v2_precision_recall", """WITH tr AS (SELECT DISTINCT user_id, release_id FROM collected WHERE date_added < TIMESTAMP '2024-01-20 00:00:00'), te AS (SELECT DISTINCT user_id, release_id FROM collected WHERE date_added >= TIMESTAMP '2024-01-20 00:00:00' AND (user_id, release_id) NOT IN (SELECT user_id, release_id FROM tr)),
    pop AS (SELECT release_id, count(*) AS n FROM tr GROUP BY 1), rec AS (SELECT user_id, release_id FROM (SELECT u.user_id, p.release_id, row_number() OVER (PARTITION BY u.user_id ORDER BY n DESC, p.release_id) AS rn FROM (SELECT DISTINCT user_id FROM te) u CROSS JOIN pop p WHERE (u.user_id, p.release_id) NOT IN (SELECT user_id, release_id FROM tr)) WHERE rn <= 10)
    SELECT te.user_id, count(*) AS held_out, count(rec.release_id) AS hits, CAST(floor(count(rec.release_id) / 10 * 1e6 + 0.5) AS BIGINT) AS precision_ppm, CAST(floor(count(rec.release_id) / count(*) * 1e6 + 0.5) AS BIGINT) AS recall_ppm FROM te LEFT JOIN rec ON te.user_id = rec.user_id AND te.release_id = rec.release_id GROUP BY 1""")
def precision_recall(c: Catalog, cut: str = "2024-01-20", k: int = 10) -> DataFrame:
    """Replay of the popularity baseline over a split in time: what precedes the cut is all it may see.

    Each user's list is the k most popular releases that the user does not hold: it lies within the first k + h, where h is what the user
    holds. So a user meets that many ranks, by a join on the rank; all users together meet k each and the training rows once.
    """
    at = F.lit(cut).cast("timestamp_ntz")
    keys = ["user_id", "release_id"]
    train = c.collected.where(F.col("date_added") < at).select(*keys).distinct()
    test = c.collected.where(F.col("date_added") >= at).select(*keys).distinct().join(train, keys, "left_anti")
    most = train.groupBy("user_id").agg(F.count("*").alias("h")).agg(F.coalesce(F.max("h"), F.lit(0))).first()[0]
    popular = train.groupBy("release_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "release_id").limit(k + most)
    ranked = popular.select("release_id", F.row_number().over(Window.orderBy(F.desc("n"), "release_id")).alias("pos"))
    own = test.select("user_id").distinct().join(train.groupBy("user_id").agg(F.count("*").alias("h")), "user_id", "left").fillna(0, ["h"])
    users = own.select("user_id", F.explode(F.sequence(F.lit(1), (F.lit(k) + F.col("h")).cast("int"))).alias("pos")).join(ranked, "pos")
    rec = top_n(users.join(train, keys, "left_anti"), ["user_id"], ["pos"], k).select(*keys, F.lit(1).alias("hit"))
    out = test.join(rec, keys, "left").groupBy("user_id").agg(F.count("*").alias("held_out"), F.count("hit").alias("hits"))
    ppm = lambda x: F.floor(x * 10**6 + 0.5).cast("long")
    return out.select("user_id", "held_out", "hits", ppm(F.col("hits") / k).alias("precision_ppm"), ppm(F.col("hits") / F.col("held_out")).alias("recall_ppm"))


@query("v3_catalogue_coverage", "SELECT count(DISTINCT c.release_id) AS covered, (SELECT count(*) FROM releases) AS catalog, count(DISTINCT c.user_id) AS users FROM collected c JOIN releases r ON c.release_id = r.release_id")
def catalogue_coverage(c: Catalog) -> DataFrame:
    held = c.collected.join(c.releases.select("release_id"), "release_id", "left_semi").agg(F.count_distinct("release_id").alias("covered"), F.count_distinct("user_id").alias("users"))
    return held.join(F.broadcast(c.releases.agg(F.count("*").alias("catalog"))))


@query("v4_spearman", """WITH n AS (SELECT a.artist_id, nation, count(*) AS x, count(DISTINCT release_id) % 17 AS y FROM artists a JOIN by_raw b ON a.artist_id = b.artist_id GROUP BY 1, 2), r AS (SELECT nation, rank() OVER (PARTITION BY nation ORDER BY x) + (count(*) OVER (PARTITION BY nation, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY nation ORDER BY y) + (count(*) OVER (PARTITION BY nation, y) - 1) / 2 AS ry FROM n)
    SELECT nation, count(*) AS n, CASE WHEN count(*) > 2 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN CAST(floor(round(corr(rx, ry), 9) * 10000 + 0.5) AS BIGINT) END AS rho FROM r GROUP BY 1""")
def spearman(c: Catalog) -> DataFrame:
    """Pearson's correlation of average ranks within each nation; null for under three artists or a constant."""
    n = c.by_raw.join(c.artists.select("artist_id", "nation"), "artist_id").groupBy("artist_id", "nation").agg(F.count("*").alias("x"), (F.count_distinct("release_id") % 17).alias("y"))
    rank = lambda v: F.rank().over(Window.partitionBy("nation").orderBy(v)) + (F.count("*").over(Window.partitionBy("nation", v)) - 1) / 2
    r = n.select("nation", rank("x").alias("rx"), rank("y").alias("ry"))
    out = r.groupBy("nation").agg(F.count("*").alias("n"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.corr("rx", "ry").alias("c"))
    return out.select("nation", "n", F.when((F.col("n") > 2) & (F.col("sx") > 0) & (F.col("sy") > 0), F.floor(F.round("c", 9) * 10**4 + 0.5).cast("long")).alias("rho"))


@query("v13_judged_precision", "SELECT source, count(*) AS shown, count(quality) AS judged, CASE WHEN count(quality) > 0 THEN CAST(floor(avg(quality) * 1e6 + 0.5) AS BIGINT) END AS precision_ppm FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def judged_precision(c: Catalog) -> DataFrame:
    """Precision over judged items only; null where none is judged."""
    df = c.table("documents").select("doc_id", "source").join(c.table("labels").select("doc_id", "quality"), "doc_id", "left").groupBy("source")
    return df.agg(F.count("*").alias("shown"), F.count("quality").alias("judged"), F.floor(F.avg("quality") * 10**6 + 0.5).cast("long").alias("precision_ppm"))
