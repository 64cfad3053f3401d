"""Bounded folds, scope states, reverts and replays (sections 2.1, 2.12, 2.14, 2.15 and 2.21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decade, names, top_n
from ..plans import ORACLES, Catalog, OfUsers, query
from .collecting import _LATEST, _LISTS, label_lists, linked
from .discover import _HEUR
from .fit import fit
from .rarity import _SCORED, rarity_scores
from .similarity import similar_artists
from .temporal import precision_recall, scope_units

KEYS = ["user_id", "release_id"]


# folds


def _folded_sql(budget: int) -> str:
    """By the places of each decade's last master, which the plan below has no need of."""
    return f"""WITH m AS (SELECT label_id, master_id, min(CASE WHEN year > 0 THEN year END) AS y, count(*) AS n FROM releases JOIN masters USING (release_id) GROUP BY 1, 2),
    o AS (SELECT label_id, coalesce(CAST(y - y % 10 AS VARCHAR), 'undated') AS d, row_number() OVER (PARTITION BY label_id ORDER BY n DESC, master_id) AS r FROM m),
    f AS (SELECT label_id, r, CASE WHEN r = max(r) OVER (PARTITION BY label_id, d) THEN 1 ELSE 0 END AS ends FROM o),
    k AS (SELECT label_id, r, coalesce(sum(ends) OVER (PARTITION BY label_id ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS b FROM f),
    best AS (SELECT label_id, max(r) AS kept, arg_max(b, r) AS b FROM k WHERE r + b <= {budget} GROUP BY 1), t AS (SELECT label_id, count(*) AS masters, count(DISTINCT d) AS decades FROM o GROUP BY 1)
    SELECT t.label_id, masters, decades, CAST(CASE WHEN kept IS NOT NULL THEN kept WHEN decades <= {budget} THEN 0 ELSE {budget - 1} END AS BIGINT) AS kept,
        CAST(CASE WHEN kept IS NOT NULL THEN b WHEN decades <= {budget} THEN decades ELSE 1 END AS BIGINT) AS buckets, CASE WHEN kept IS NULL AND decades > {budget} THEN 'all' ELSE 'decade' END AS mode FROM t LEFT JOIN best USING (label_id)"""


@query("b4_master_folds", _folded_sql(8))
def master_folds(c: Catalog, budget: int = 8) -> DataFrame:
    """How many masters of each label a view of ``budget`` entries draws, and into how many decades (or one bucket) the others fold.

    Masters of most releases come first. Only the first ``budget`` of a label can be drawn, so no window holds more of it: a decade
    needs no bucket once the masters drawn are as many as it has.
    """
    of = c.releases.join(c.masters, "release_id").groupBy("label_id", "master_id").agg(F.min(F.when(F.col("year") > 0, F.col("year"))).alias("y"), F.count("*").alias("n"))
    of = of.withColumn("d", F.coalesce(decade(F.col("y")).cast("string"), F.lit("undated")))
    sizes = of.groupBy("label_id", "d").agg(F.count("*").alias("size"))
    totals = sizes.groupBy("label_id").agg(F.sum("size").alias("masters"), F.count("*").alias("decades"))
    first = top_n(of.select("label_id", "master_id", "d", "n"), ["label_id"], [F.desc("n"), "master_id"], budget, rank="r")
    drawn = F.row_number().over(Window.partitionBy("label_id", "d").orderBy("r"))
    rows = first.withColumn("drawn", drawn).join(sizes, ["label_id", "d"]).join(totals, "label_id")
    whole = F.sum((F.col("drawn") == F.col("size")).cast("int")).over(Window.partitionBy("label_id").orderBy("r"))
    rows = rows.withColumn("b", F.col("decades") - whole).where(F.col("r") + F.col("b") <= budget)
    best = rows.groupBy("label_id").agg(F.max(F.struct("r", "b")).alias("best"))
    few = F.col("decades") <= budget
    pick = lambda got, none, many: F.coalesce(F.col(f"best.{got}"), F.when(few, none).otherwise(many)).cast("long")
    return totals.join(best, "label_id", "left").select(
        "label_id", "masters", "decades", pick("r", F.lit(0), F.lit(budget - 1)).alias("kept"), pick("b", F.col("decades"), F.lit(1)).alias("buckets"),
        F.when(F.col("best").isNull() & ~few, "all").otherwise("decade").alias("mode"),
    )


@query("b5_release_folds", """WITH a AS (SELECT master_id, min(release_id) AS anchor FROM masters GROUP BY 1), st AS (SELECT release_id FROM collected UNION SELECT release_id FROM wanted),
    i AS (SELECT r.label_id, m.master_id, r.release_id = a.anchor AS orig, st.release_id IS NOT NULL AS held FROM releases r JOIN masters m USING (release_id) JOIN a ON a.master_id = m.master_id LEFT JOIN st ON st.release_id = r.release_id),
    s AS (SELECT label_id, count(*) AS s0, count(*) FILTER (WHERE orig OR held) + count(DISTINCT master_id) FILTER (WHERE NOT (orig OR held)) AS s1, count(*) FILTER (WHERE held) + count(DISTINCT master_id) FILTER (WHERE NOT held) AS s2, count(DISTINCT master_id) AS s3 FROM i GROUP BY 1)
    SELECT label_id, s0 AS releases, CASE WHEN s0 <= 8 THEN 'everything' WHEN s1 <= 8 THEN 'originals' WHEN s2 <= 8 THEN 'stateful' ELSE 'folded' END AS strategy, CASE WHEN s0 <= 8 THEN s0 WHEN s1 <= 8 THEN s1 WHEN s2 <= 8 THEN s2 ELSE s3 END AS entries FROM s""")
def release_folds(c: Catalog, room: int = 8) -> DataFrame:
    """The finest way to draw each label's releases in ``room`` entries: all; originals and those held or wanted, with one fold for the rest of each master; without originals; folds alone."""
    anchors = c.masters.groupBy("master_id").agg(F.min("release_id").alias("anchor"))
    stateful = c.collected.select("release_id").union(c.wanted.select("release_id")).distinct().withColumn("held", F.lit(True))
    items = c.releases.select("release_id", "label_id").join(c.masters, "release_id").join(anchors, "master_id").join(stateful, "release_id", "left")
    held = F.col("held").isNotNull()
    kept = held | (F.col("release_id") == F.col("anchor"))
    per = items.groupBy("label_id", "master_id").agg(F.count("*").alias("n"), F.count_if(kept).alias("k1"), F.count_if(held).alias("k2"))
    fold = lambda k: F.sum(F.col(k) + (F.col(k) < F.col("n")).cast("long"))
    sums = per.groupBy("label_id").agg(F.sum("n").alias("s0"), fold("k1").alias("s1"), fold("k2").alias("s2"), F.count("*").alias("s3"))
    first = lambda *of: F.when(F.col("s0") <= room, of[0]).when(F.col("s1") <= room, of[1]).when(F.col("s2") <= room, of[2]).otherwise(of[3])
    return sums.select("label_id", F.col("s0").alias("releases"), first(*map(F.lit, ("everything", "originals", "stateful", "folded"))).alias("strategy"), first(*map(F.col, ("s0", "s1", "s2", "s3"))).alias("entries"))


@query("b6_focus_pages", """WITH n AS (SELECT label_id, count(*) AS n, 5 % ((count(*) + 7) // 8) AS page FROM on_ GROUP BY 1), o AS (SELECT label_id, release_id, (row_number() OVER (PARTITION BY label_id ORDER BY release_id) - 1) // 8 AS p FROM on_)
    SELECT label_id, CAST(page AS BIGINT) AS page, count(*) AS shown, any_value(n) - count(*) AS rest, string_agg(CAST(release_id AS VARCHAR), '|' ORDER BY release_id) AS members FROM n JOIN o USING (label_id) WHERE p = page GROUP BY 1, 2""")
def focus_pages(c: Catalog, cursor: int = 5, size: int = 8) -> DataFrame:
    """The page of each label's releases that a cursor names, counting on from the first page after the last. A page ends within the first (cursor + 1) x size members."""
    total = c.on.groupBy("label_id").agg(F.count("*").alias("n")).withColumn("page", F.lit(cursor).cast("long") % F.ceil(F.col("n") / size))
    first = top_n(c.on, ["label_id"], ["release_id"], (cursor + 1) * size, rank="r")
    rows = first.join(total, "label_id").where(F.floor((F.col("r") - 1) / size) == F.col("page")).groupBy("label_id", "page", "n")
    members = F.array_join(F.transform(F.sort_array(F.collect_list("release_id")), lambda x: x.cast("string")), "|")
    return rows.agg(F.count("*").alias("shown"), members.alias("members")).select("label_id", "page", "shown", (F.col("n") - F.col("shown")).alias("rest"), "members")


@query("b13_known_candidates", """WITH md AS (SELECT release_id, min(medium) FILTER (WHERE medium LIKE '%_F') AS medium FROM media GROUP BY 1), f AS (SELECT r.release_id, m.master_id, r.year, r.label_id, md.medium FROM releases r JOIN masters m USING (release_id) LEFT JOIN md USING (release_id))
    SELECT o.release_id, count(*) AS candidates, count(*) FILTER (WHERE o.year = x.year AND o.label_id = x.label_id AND coalesce(o.medium = x.medium, true)) AS compatible, count(*) FILTER (WHERE NOT (o.year = x.year AND o.label_id = x.label_id AND coalesce(o.medium = x.medium, true))) AS contradicting
    FROM f o JOIN (SELECT DISTINCT release_id FROM wanted) w USING (release_id) JOIN f x ON x.master_id = o.master_id GROUP BY 1""")
def known_candidates(c: Catalog) -> DataFrame:
    """How many pressings of its master agree with each wanted release in year, label and medium; a medium not known contradicts nothing.

    Candidates are counted by their fields first and looked up by them, so a master's pressings are never paired.
    """
    medium = c.media.where(F.col("medium").endswith("_F")).groupBy("release_id").agg(F.min("medium").alias("medium"))
    of = c.releases.select("release_id", "year", "label_id").join(c.masters, "release_id").join(medium, "release_id", "left")
    same = ["master_id", "year", "label_id"]
    total = of.groupBy("master_id").agg(F.count("*").alias("candidates"))
    alike = of.groupBy(*same).agg(F.count("*").alias("all"), F.count_if(F.col("medium").isNull()).alias("open"))
    exact = of.where("medium is not null").groupBy(*same, "medium").agg(F.count("*").alias("exact"))
    asked = of.join(c.wanted.select("release_id").distinct(), "release_id", "left_semi")
    rows = asked.join(total, "master_id").join(alike, same).join(exact, [*same, "medium"], "left")
    agree = F.when(F.col("medium").isNull(), F.col("all")).otherwise(F.col("open") + F.coalesce("exact", F.lit(0)))
    return rows.select("release_id", "candidates", agree.alias("compatible"), (F.col("candidates") - agree).alias("contradicting"))


@query("b16_lexical_spans", "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS BIGINT) AS letters, CAST(len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS BIGINT) AS digits, CAST(len(regexp_extract_all(coalesce(text, ''), '[\\x21-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7e]+')) AS BIGINT) AS marks FROM documents")
def lexical_spans(c: Catalog) -> DataFrame:
    """How many spans of letters, digits and marks each text falls into."""
    of = lambda regex: F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(regex), F.lit(0))).cast("long")
    return c.table("documents").select("doc_id", of("[A-Za-z]+").alias("letters"), of("[0-9]+").alias("digits"), of(r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+").alias("marks"))


@query("b18_public_evidence", "SELECT label_id, count(*) AS total, count(*) > 20 AS truncated, string_agg(release_id || ':' || year, '|' ORDER BY release_id) FILTER (WHERE rn <= 20) AS evidence FROM (SELECT label_id, release_id, year, row_number() OVER (PARTITION BY label_id ORDER BY release_id) AS rn FROM releases) GROUP BY 1")
def public_evidence(c: Catalog, limit: int = 20) -> DataFrame:
    """The allowed fields (id and year) of each label's first releases, with a flag where there are more."""
    total = c.releases.groupBy("label_id").agg(F.count("*").alias("total"))
    first = top_n(c.releases.select("label_id", "release_id", "year"), ["label_id"], ["release_id"], limit).groupBy("label_id")
    said = F.transform(F.sort_array(F.collect_list(F.struct("release_id", "year"))), lambda x: F.concat_ws(":", x["release_id"].cast("string"), x["year"].cast("string")))
    return total.join(first.agg(F.array_join(said, "|").alias("evidence")), "label_id").select("label_id", "total", (F.col("total") > limit).alias("truncated"), "evidence")


# scope states


@query("z22_state_rollup", """WITH s AS (SELECT user_id, release_id, true AS own FROM collected UNION SELECT user_id, release_id, false FROM wanted)
    SELECT user_id, master_id, CASE WHEN bool_or(own) THEN 'owned' ELSE 'wanted' END AS state, min(CASE WHEN year > 0 THEN year END) AS first_year, max(CASE WHEN year > 0 THEN year END) AS last_year FROM s JOIN masters USING (release_id) JOIN releases USING (release_id) GROUP BY 1, 2""")
def state_rollup(c: Catalog) -> DataFrame:
    """A master is owned if any release of it is, else wanted, with the span of years."""
    rows = c.collected.select(*KEYS, F.lit(True).alias("own")).unionByName(c.wanted.select(*KEYS, F.lit(False).alias("own")))
    dated = c.masters.join(c.releases.select("release_id", F.when(F.col("year") > 0, F.col("year")).alias("year")), "release_id")
    out = rows.groupBy(*KEYS).agg(F.bool_or("own").alias("own")).join(dated, "release_id").groupBy("user_id", "master_id")
    return out.agg(F.when(F.bool_or("own"), "owned").otherwise("wanted").alias("state"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("z23_unit_references", """WITH x AS (SELECT DISTINCT l_orderkey AS release_id FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1))
    SELECT r.release_id, CASE WHEN x.release_id IS NOT NULL THEN 'conflict' WHEN m.master_id IS NULL THEN 'unresolved' ELSE 'grouped' END AS state, CASE WHEN x.release_id IS NULL THEN m.master_id END AS unit FROM releases r LEFT JOIN masters m USING (release_id) LEFT JOIN x USING (release_id)""")
def unit_references(c: Catalog) -> DataFrame:
    """The unit that each release counts for; rows of one (release, part) that contradict each other leave it open."""
    pairs = c.lines.groupBy(F.col("l_orderkey").alias("release_id"), "l_partkey").agg(F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b"))
    units = pairs.groupBy("release_id").agg(F.min("l_partkey").alias("unit"), F.bool_or(F.col("a") != F.col("b")).alias("bad"))
    bad = F.coalesce("bad", F.lit(False))
    state = F.when(bad, "conflict").when(F.col("unit").isNull(), "unresolved").otherwise("grouped")
    return c.releases.select("release_id").join(units, "release_id", "left").select("release_id", state.alias("state"), F.when(~bad, F.col("unit")).alias("unit"))


@query("z24_objectives", f"SELECT user_id, label_id, units AS universe, owned, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value >= 20) THEN missing ELSE 0 END AS review FROM ({ORACLES['b9_scope_units']})")
def objectives(c: Catalog) -> DataFrame:
    """Universe and owned units of each held label; what is not owned is up for review where the user's record is incomplete."""
    open_ = c.events.where("event_type = 'error' and value >= 20").select("user_id").distinct().withColumn("open", F.lit(True))
    rows = scope_units(c).join(open_, "user_id", "left")
    return rows.select("user_id", "label_id", F.col("units").alias("universe"), "owned", F.when(F.col("open").isNotNull(), F.col("missing")).otherwise(0).alias("review"))


@query("z19_policy_pools", """WITH p AS (SELECT DISTINCT user_id, k AS release_id FROM ev WHERE event_type = 'view' AND k IN (SELECT release_id FROM releases)), o AS (SELECT DISTINCT user_id, release_id FROM collected)
    SELECT p.user_id, count(*) AS offered, count(*) FILTER (WHERE o.user_id IS NOT NULL) AS owned, count(*) FILTER (WHERE o.user_id IS NULL) AS pool FROM p LEFT JOIN o ON o.user_id = p.user_id AND o.release_id = p.release_id GROUP BY 1""")
def policy_pools(c: Catalog) -> DataFrame:
    """Candidates that a policy may rank: known releases once each, without those the user owns."""
    offered = c.events.where("event_type = 'view'").select("user_id", F.col("k").alias("release_id")).distinct().join(c.releases.select("release_id"), "release_id", "left_semi")
    owned = c.collected.select(*KEYS).distinct().withColumn("own", F.lit(True))
    rows = offered.join(owned, KEYS, "left").groupBy("user_id").agg(F.count("*").alias("offered"), F.count("own").alias("owned"))
    return rows.withColumn("pool", F.col("offered") - F.col("owned"))


@query("z21_exact_signatures", "WITH s AS (SELECT p_partkey, regexp_replace(upper(trim(p_name)), '[^A-Z0-9]+', ' ', 'g') AS signature FROM part) SELECT p_partkey, signature, count(*) OVER (PARTITION BY signature) - 1 AS candidates FROM s")
def exact_signatures(c: Catalog) -> DataFrame:
    """How many other names have the same signature as a whole."""
    rows = c.table("part").select("p_partkey", F.regexp_replace(F.upper(F.trim("p_name")), "[^A-Z0-9]+", " ").alias("signature"))
    return rows.join(rows.groupBy("signature").agg((F.count("*") - 1).alias("candidates")), "signature").select("p_partkey", "signature", "candidates")


@query("z26_history_pages", "SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM ev) WHERE place <= 20")
def history_pages(c: Catalog, limit: int = 20) -> DataFrame:
    """The newest records of each kind."""
    first = top_n(c.events.select("event_type", "event_id", "ts"), ["event_type"], [F.desc("ts"), F.desc("event_id")], limit, rank="place")
    return first.select("event_type", "event_id", F.col("place").cast("long"))


# ledger


@query("i7_work_facts", """WITH al AS (SELECT k, user_id, event_id, lead(ts) OVER (PARTITION BY k ORDER BY ts, event_id) AS valid_to FROM ev WHERE event_type = 'signup'), a AS (SELECT k, count(*) AS aliases, max(user_id) FILTER (WHERE valid_to IS NULL) AS holder FROM al GROUP BY 1)
    SELECT e.k, coalesce(any_value(a.aliases), 0) AS aliases, any_value(a.holder) AS holder, count(*) FILTER (WHERE event_type = 'purchase') AS links, count(*) FILTER (WHERE event_type = 'error') AS moves, count(*) AS events FROM ev e LEFT JOIN a USING (k) WHERE e.k IS NOT NULL GROUP BY 1""")
def work_facts(c: Catalog) -> DataFrame:
    """Everything the ledger has of a work, from one read: versions, current holder, links and moves."""
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    holder = F.max_by("user_id", F.when(F.col("event_type") == "signup", F.struct("ts", "event_id")))
    return c.events.where("k is not null").groupBy("k").agg(of("signup").alias("aliases"), holder.alias("holder"), of("purchase").alias("links"), of("error").alias("moves"), F.count("*").alias("events"))


@query("i11_work_planes", """WITH s AS (SELECT master_id, release_id, min(ts) AS seen FROM masters JOIN ev ON ev.k = release_id WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY master_id ORDER BY release_id) AS rn FROM s)
    SELECT master_id, count(*) AS editions, count(*) > 10 AS truncated, string_agg(CAST(release_id AS VARCHAR), '|' ORDER BY release_id) FILTER (WHERE rn <= 10) AS listed, strftime(min(seen), '%Y-%m-%d %H:%M') AS since FROM o GROUP BY 1""")
def work_planes(c: Catalog, at: str = "2024-01-15", cap: int = 10) -> DataFrame:
    """A work's editions as an instant knew them; the list is capped, its count is not."""
    seen = c.events.where(F.col("k").isNotNull() & (F.col("ts") <= F.lit(at).cast("timestamp_ntz"))).groupBy(F.col("k").alias("release_id")).agg(F.min("ts").alias("at"))
    rows = c.masters.join(seen, "release_id")
    total = rows.groupBy("master_id").agg(F.count("*").alias("editions"), F.date_format(F.min("at"), "yyyy-MM-dd HH:mm").alias("since"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("release_id")), lambda x: x.cast("string")), "|")
    listed = top_n(rows.select("master_id", "release_id"), ["master_id"], ["release_id"], cap).groupBy("master_id").agg(ids.alias("listed"))
    return total.join(listed, "master_id").select("master_id", "editions", (F.col("editions") > cap).alias("truncated"), "listed", "since")


@query("i13_reverted", """WITH al AS (SELECT k, event_id, ts AS valid_from, lead(ts) OVER (PARTITION BY k ORDER BY ts, event_id) AS valid_to FROM ev WHERE event_type = 'signup' AND k IS NOT NULL)
    SELECT c.k, c.event_id AS closed, max(p.event_id) AS reopened, CASE WHEN max(p.event_id) IS NULL THEN 'refused' ELSE 'reverted' END AS state FROM al c LEFT JOIN al p ON p.k = c.k AND p.valid_to = c.valid_from WHERE c.valid_to IS NULL GROUP BY 1, 2""")
def reverted(c: Catalog) -> DataFrame:
    """Each key's current row is undone: the row that ended at the instant it began is open again; without one the revert is refused.

    Rows are joined on that instant, so among rows of equal instants the one of the greatest id is opened.
    """
    rows = c.events.where("event_type = 'signup' and k is not null").select("k", "event_id", "ts")
    ends = F.lead("ts").over(Window.partitionBy("k").orderBy("ts", "event_id"))
    versions = rows.withColumn("valid_to", ends)
    open_ = versions.where("valid_to is null").select("k", F.col("event_id").alias("closed"), F.col("ts").alias("valid_to"))
    before = versions.where("valid_to is not null").groupBy("k", "valid_to").agg(F.max("event_id").alias("reopened"))
    return open_.join(before, ["k", "valid_to"], "left").select("k", "closed", "reopened", F.when(F.col("reopened").isNull(), "refused").otherwise("reverted").alias("state"))


@query("i17_finalized_bounds", "SELECT r.release_id, strftime(arg_min(e.ts, e.event_id), '%Y-%m-%d %H:%M:%S') AS bound FROM releases r JOIN label_nodes l USING (label_id) JOIN masters m USING (release_id) JOIN part p ON p.p_partkey = m.master_id JOIN ev e ON e.k = r.release_id WHERE r.year > 0 GROUP BY 1")
def finalized_bounds(c: Catalog) -> DataFrame:
    """The instant of each release's first link; releases without a year, or of an unknown label or work, are dropped."""
    link = c.events.where("k is not null").groupBy(F.col("k").alias("release_id")).agg(F.min_by("ts", "event_id").alias("at"))
    works = c.masters.join(c.table("part").select(F.col("p_partkey").alias("master_id")), "master_id", "left_semi")
    rows = c.releases.where("year > 0").join(c.labels.select("label_id"), "label_id", "left_semi").join(works, "release_id", "left_semi")
    return rows.join(link, "release_id").select("release_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("bound"))


@query("z16_reattachment_outcomes", f"""WITH {_LATEST}, c AS (SELECT u.user_id, a.k AS linked, b.k AS candidate FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN l a ON a.user_id = u.user_id AND a.event_type = 'signup' LEFT JOIN l b ON b.user_id = u.user_id AND b.event_type = 'error' WHERE a.k IS DISTINCT FROM b.k)
    SELECT CASE WHEN candidate IS NULL THEN 'absent' WHEN candidate IN (SELECT release_id FROM collected WHERE release_id IS NOT NULL) THEN 'held' WHEN candidate IN (SELECT linked FROM c WHERE linked IS NOT NULL) THEN 'taken' WHEN linked IS NULL THEN 'attached' ELSE 'moved' END AS outcome, count(*) AS n FROM c GROUP BY 1""")
def reattachment_outcomes(c: Catalog) -> DataFrame:
    """What becomes of each candidate link: the first guard that stops it, else attached or moved."""
    rows = linked(c)
    held = c.collected.select(F.col("release_id").alias("candidate")).distinct().withColumn("held", F.lit(True))
    taken = rows.where("linked is not null").select(F.col("linked").alias("candidate")).distinct().withColumn("taken", F.lit(True))
    rows = rows.join(held, "candidate", "left").join(taken, "candidate", "left")
    first = F.when(F.col("candidate").isNull(), "absent").when(F.col("held").isNotNull(), "held").when(F.col("taken").isNotNull(), "taken").when(F.col("linked").isNull(), "attached")
    return rows.groupBy(first.otherwise("moved").alias("outcome")).agg(F.count("*").alias("n"))


# stored copies


@query("s13_owned_copies", """WITH s AS (SELECT user_id, release_id, min(date_added) AS at FROM collected WHERE date_added < TIMESTAMP '2024-01-20 00:00:00' AND release_id IS NOT NULL GROUP BY 1, 2), i AS (SELECT user_id, release_id, max(CASE WHEN value >= 2 THEN date_added END) AS at FROM collected WHERE release_id IS NOT NULL GROUP BY 1, 2)
    SELECT user_id, release_id, CASE WHEN s.user_id IS NULL THEN 'inserted' WHEN i.at IS NOT NULL AND i.at IS DISTINCT FROM s.at THEN 'updated' ELSE 'unchanged' END AS state, strftime(coalesce(i.at, s.at), '%Y-%m-%d') AS acquired FROM i LEFT JOIN s USING (user_id, release_id)""")
def owned_copies(c: Catalog, cut: str = "2024-01-20") -> DataFrame:
    """One copy for each collection row: inserted, or updated only where something differs; an unknown instant changes nothing."""
    rows = c.collected.where("release_id is not null")
    stored = F.min(F.when(F.col("date_added") < F.lit(cut).cast("timestamp_ntz"), F.col("date_added")))
    both = rows.groupBy(*KEYS).agg(stored.alias("s"), F.max(F.when(F.col("value") >= 2, F.col("date_added"))).alias("i"))
    state = F.when(F.col("s").isNull(), "inserted").when(F.col("i").isNotNull() & (F.col("i") != F.col("s")), "updated").otherwise("unchanged")
    return both.select(*KEYS, state.alias("state"), F.date_format(F.coalesce("i", "s"), "yyyy-MM-dd").alias("acquired"))


@query("s19_backfilled_media", "WITH s AS (SELECT release_id, string_agg(DISTINCT medium, '|' ORDER BY medium) FILTER (WHERE medium LIKE '%_F') AS stored, string_agg(DISTINCT family, '|' ORDER BY family) AS formats FROM media GROUP BY 1) SELECT user_id, release_id, coalesce(any_value(stored), any_value(formats)) AS media, any_value(stored) IS NULL AS filled FROM collected JOIN s USING (release_id) GROUP BY 1, 2")
def backfilled_media(c: Catalog) -> DataFrame:
    """The media of collection rows, filled from the raw formats where none is stored."""
    of = c.media.join(c.collected.select("release_id").distinct(), "release_id", "left_semi").groupBy("release_id")
    stored = names("family").alias("formats"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("medium").endswith("_F"), F.col("medium")))), "|").alias("stored")
    found = of.agg(*stored).withColumn("filled", F.col("stored") == "")
    return c.collected.select(*KEYS).distinct().join(found, "release_id").select(*KEYS, F.when(F.col("filled"), F.col("formats")).otherwise(F.col("stored")).alias("media"), "filled")


@query("s20_projected_ids", "WITH l AS (SELECT k, max_by(user_id, (ts, event_id)) AS native_id FROM ev WHERE event_type = 'signup' GROUP BY 1), n AS (SELECT 'artist' AS kind, artist_id AS id FROM artists UNION ALL SELECT 'label', label_id FROM label_nodes UNION ALL SELECT 'master', p_partkey FROM part UNION ALL SELECT 'release', release_id FROM releases) SELECT kind, id, native_id FROM n LEFT JOIN l ON l.k = n.id")
def projected_ids(c: Catalog) -> DataFrame:
    """The current native id of every node of the four kinds, null where no alias is open."""
    current = c.events.where("event_type = 'signup'").groupBy(F.col("k").alias("id")).agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("native_id"))
    nodes = None
    for kind, df, key in (("artist", c.artists, "artist_id"), ("label", c.labels, "label_id"), ("master", c.table("part"), "p_partkey"), ("release", c.releases, "release_id")):
        one = df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
        nodes = one if nodes is None else nodes.unionByName(one)
    return nodes.join(current, "id", "left").select("kind", "id", "native_id")


@query("l18_current_lists", "WITH v AS (SELECT max(CAST(ts AS DATE)) AS d FROM ev WHERE event_type = 'view'), l AS (SELECT user_id, string_agg(DISTINCT k, '|' ORDER BY k) AS listed FROM ev, v WHERE event_type = 'view' AND CAST(ts AS DATE) = d AND k IS NOT NULL GROUP BY 1) SELECT u.user_id, CASE WHEN v.d IS NULL THEN 'no release' WHEN l.user_id IS NULL THEN 'absent' ELSE 'listed' END AS state, coalesce(l.listed, '') AS listed FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN v LEFT JOIN l USING (user_id)")
def current_lists(c: Catalog) -> DataFrame:
    """Each user's list in the newest release of lists; a user who is absent from it differs from there being no release."""
    views = c.events.where("event_type = 'view'").select("user_id", "k", F.to_date("ts").alias("d"))
    newest = views.agg(F.max("d").alias("newest"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_set("k")), lambda x: x.cast("string")), "|")
    lists = views.join(F.broadcast(newest), F.col("d") == F.col("newest")).where("k is not null").groupBy("user_id").agg(ids.alias("listed"))
    rows = c.events.select("user_id").distinct().join(F.broadcast(newest)).join(lists, "user_id", "left")
    return rows.select("user_id", F.when(F.col("newest").isNull(), "no release").when(F.col("listed").isNull(), "absent").otherwise("listed").alias("state"), F.coalesce("listed", F.lit("")).alias("listed"))


@query("m14_hub_changes", "SELECT genre, count(*) FILTER (WHERE year < 1998) AS stored, count(*) AS current, count(*) FILTER (WHERE year < 1998) <> count(*) AS rebuild FROM genres JOIN releases USING (release_id) GROUP BY 1")
def hub_changes(c: Catalog, before: int = 1998) -> DataFrame:
    """Which hubs have other release counts than when they were built, and so are built again."""
    rows = c.genres.join(c.releases.select("release_id", "year"), "release_id").groupBy("genre")
    return rows.agg(F.count_if(F.col("year") < before).alias("stored"), F.count("*").alias("current")).withColumn("rebuild", F.col("stored") != F.col("current"))


@query("x9_import_watermark", "WITH d AS (SELECT CAST(ts AS DATE) AS d FROM ev GROUP BY 1 HAVING bool_or(event_type = 'purchase') AND bool_or(event_type = 'signup')) SELECT strftime(max(d), '%Y-%m-%d') AS newest, count(*) AS pending FROM d WHERE d > DATE '2024-01-10'")
def import_watermark(c: Catalog, done: str = "2024-01-10") -> DataFrame:
    """The newest version that both stores have, among those after what was acted on."""
    days = c.events.where("event_type in ('purchase', 'signup')").groupBy(F.to_date("ts").alias("d")).agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    return days.where((F.col("a") != F.col("b")) & (F.col("d") > F.lit(done).cast("date"))).agg(F.date_format(F.max("d"), "yyyy-MM-dd").alias("newest"), F.count("*").alias("pending"))


# compositions


@query("z4_guarded_lists", f"""{_HEUR.replace(" AND a % 100 = 0", "")}, n AS (SELECT artist_id, count(*) AS n FROM by_ GROUP BY 1), h AS (SELECT id, count(*) AS listed FROM hr GROUP BY 1)
    SELECT a.artist_id, CASE WHEN n.n IS NULL THEN 'unknown' WHEN n.n < 3 THEN 'too few' ELSE 'served' END AS status, CASE WHEN n.n >= 3 THEN coalesce(h.listed, 0) ELSE 0 END AS listed FROM artists a LEFT JOIN n USING (artist_id) LEFT JOIN h ON h.id = a.artist_id""")
def guarded_lists(c: Catalog, least: int = 3) -> DataFrame:
    """How many similar artists each artist is served; one without releases or with too few is refused."""
    size = c.by.groupBy("artist_id").agg(F.count("*").alias("n"))
    lists = similar_artists(c).groupBy(F.col("a").alias("artist_id")).agg(F.count("*").alias("listed"))
    rows = c.artists.select("artist_id").join(size, "artist_id", "left").join(lists, "artist_id", "left")
    status = F.when(F.col("n").isNull(), "unknown").when(F.col("n") < least, "too few").otherwise("served")
    return rows.select("artist_id", status.alias("status"), F.when(F.col("n") >= least, F.coalesce("listed", F.lit(0))).otherwise(0).alias("listed"))


@query("z7_release_fits", f"""SELECT f.user_id, f.release_id, f.fit, r.tier, r.score FROM ({ORACLES["c14_fit"]}) f LEFT JOIN ({_SCORED} SELECT release_id, tier, score FROM rated) r USING (release_id)""")
def release_fits(c: Catalog) -> DataFrame:
    """The fit of each wanted release beside its rarity, which is scored for the wanted ones."""
    # A fit is asked of releases that users have or want, so no other line is made an edge for it.
    return fit(OfUsers(c)).join(rarity_scores(c).select("release_id", "tier", "score"), "release_id", "left").select("user_id", "release_id", "fit", "tier", "score")


@query("v8_baseline_replay", f"""SELECT 'popular' AS policy, count(*) AS users, CAST(sum(held_out) AS BIGINT) AS held_out, CAST(sum(hits) AS BIGINT) AS hits FROM ({ORACLES["v2_precision_recall"]})
    UNION ALL SELECT 'labels', count(DISTINCT user_id), count(*), count(rn) FROM ({_LISTS} SELECT te.user_id, rk.rn FROM te LEFT JOIN rk ON te.user_id = rk.user_id AND te.release_id = rk.release_id)""")
def baseline_replay(c: Catalog, cut: str = "2024-01-20") -> DataFrame:
    """What each heuristic finds of what users came to hold after the cut."""
    popular = precision_recall(c, cut).agg(F.lit("popular").alias("policy"), F.count("*").alias("users"), F.coalesce(F.sum("held_out"), F.lit(0)).alias("held_out"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    test, lists = label_lists(c, cut, 20)
    rows = test.join(lists.select(*KEYS, "rn"), KEYS, "left")
    labels = rows.agg(F.lit("labels").alias("policy"), F.count_distinct("user_id").alias("users"), F.count("*").alias("held_out"), F.count("rn").alias("hits"))
    return popular.unionByName(labels)
