"""Merges of catalog items and their reverts, with an append-only ledger of what was moved (section 2.12, I12 and I13).

A merge keeps the superseded item and points its dependents to the survivor; each moved dependent is written to the ledger. Resolution is always one hop: where
the superseded item was itself a survivor, the rows that led to it are closed and opened anew to the new survivor, naming the merge that compressed them. A revert
closes its row and those, opens the rows that they replaced, and moves back the ledgered dependents that are still on the survivor; what was created there since, or
has moved on, stays. Ledger rows are never deleted.

Merges and reverts come in batches and are applied by joins on the items they name, so a batch costs what it touches, not what the catalog holds. Pairs that can't be
applied are returned with the reason and change nothing; nor may one batch build a chain, so a chain takes a batch for each of its links.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import Catalog, query
from .temporal import ensure_checkpoints

# What may cause a supersession.
CAUSES = ("edition_promotion", "catalog_reattachment")
SUPERSESSIONS = "id string, superseded bigint, survivor bigint, cause string, decision string, via_id string, valid_from bigint, valid_to bigint"
MOVES = "supersession_id string, kind string, row_id bigint, owner bigint, from_item bigint, to_item bigint, at bigint"


@dataclass(frozen=True)
class Ledger:
    #: (item_id, kind)
    items: DataFrame
    #: (kind, row_id, owner, item_id): the rows that point to items, of whatever kind of table.
    dependents: DataFrame
    supersessions: DataFrame
    moves: DataFrame

    @classmethod
    def start(cls, spark: SparkSession, items: DataFrame, dependents: DataFrame) -> Ledger:
        return cls(items, dependents, spark.createDataFrame([], SUPERSESSIONS), spark.createDataFrame([], MOVES))

    def current(self) -> DataFrame:
        return self.supersessions.where("valid_to is null")

    def resolved(self) -> DataFrame:
        """(item_id, resolved): one hop."""
        hop = self.current().select(F.col("superseded").alias("item_id"), "survivor")
        return self.items.select("item_id").join(hop, "item_id", "left").select("item_id", F.coalesce("survivor", "item_id").alias("resolved"))


def _refusals(ledger: Ledger, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``refused`` (null where the pair can merge) and ``existing``, the open row of the same pair."""
    kinds = lambda key: ledger.items.select(F.col("item_id").alias(key), F.col("kind").alias(f"{key}_kind"))
    open_ = ledger.current()
    df = pairs.join(kinds("superseded"), "superseded", "left").join(kinds("survivor"), "survivor", "left")
    df = df.join(open_.select("superseded", F.col("survivor").alias("resolves_to"), F.col("id").alias("existing")), "superseded", "left")
    df = df.join(open_.select(F.col("superseded").alias("survivor"), F.lit(True).alias("gone")), "survivor", "left")
    # Both ends of all pairs of the batch, to find pairs that meet in an item.
    ends = pairs.select(F.col("superseded").alias("item"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("survivor").alias("item"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("item").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    df = df.join(ends.select(F.col("item").alias("superseded"), F.col("up"), F.col("down").alias("s_down")), "superseded").join(ends.select(F.col("item").alias("survivor"), F.col("up").alias("v_up")), "survivor")
    why = (
        F.when(F.col("superseded") == F.col("survivor"), "an item cannot supersede itself")
        .when(F.col("superseded_kind").isNull() | F.col("survivor_kind").isNull(), "an item does not exist")
        .when(F.col("superseded_kind") != F.col("survivor_kind"), "kinds differ")
        .when(~F.col("cause").isin(*CAUSES), "unknown cause")
        .when((F.col("up") > 1) | (F.col("s_down") > 0) | (F.col("v_up") > 0), "pairs of one batch meet in an item")
        .when(F.col("gone"), "the survivor is itself superseded")
        .when(F.col("resolves_to") != F.col("survivor"), "already superseded by another item")
    )
    return df.select("superseded", "survivor", "cause", "decision", "existing", why.alias("refused"))


def merge(ledger: Ledger, pairs: DataFrame, at: int) -> tuple[Ledger, DataFrame]:
    """The ledger after the merges ``pairs`` (superseded, survivor, cause, decision) at one instant, and the refused pairs with the reason.

    A pair that is merged already opens no second row; dependents that point to the superseded item again are moved under the open one.
    """
    asked = _refusals(ledger, pairs.distinct()).checkpoint()
    refused = asked.where("refused is not null").drop("existing")
    good = asked.where("refused is null").drop("refused")
    good = good.withColumn("id", F.coalesce("existing", F.concat_ws(">", F.col("superseded").cast("string"), F.concat_ws("@", F.col("survivor").cast("string"), F.lit(str(at))))))
    none, now = F.lit(None).cast("bigint"), F.lit(at).cast("bigint")
    fresh = good.where("existing is null")
    opened = fresh.select("id", "superseded", "survivor", "cause", "decision", F.lit(None).cast("string").alias("via_id"), now.alias("valid_from"), none.alias("valid_to"))
    # Chains: what led to the superseded item leads to its survivor now.
    on = fresh.select(F.col("superseded").alias("survivor"), F.col("survivor").alias("next"), F.col("id").alias("by"))
    rows = ledger.supersessions.join(on, "survivor", "left")
    bent = F.col("by").isNotNull() & F.col("valid_to").isNull()
    compressed = rows.where(bent).select(F.concat("id", F.lit("|"), "by").alias("id"), "superseded", F.col("next").alias("survivor"), "cause", "decision", F.col("by").alias("via_id"), now.alias("valid_from"), none.alias("valid_to"))
    kept = rows.select("id", "superseded", "survivor", "cause", "decision", "via_id", "valid_from", F.when(bent, now).otherwise(F.col("valid_to")).alias("valid_to"))
    to = good.select(F.col("superseded").alias("item_id"), F.col("survivor").alias("to_item"), F.col("id").alias("supersession_id"))
    pointed = ledger.dependents.join(to, "item_id", "left").checkpoint()
    moved = pointed.where("to_item is not null").select("supersession_id", "kind", "row_id", "owner", F.col("item_id").alias("from_item"), "to_item", now.alias("at"))
    return replace(
        ledger, dependents=pointed.select("kind", "row_id", "owner", F.coalesce("to_item", "item_id").alias("item_id")),
        supersessions=kept.unionByName(opened).unionByName(compressed).checkpoint(), moves=ledger.moves.unionByName(moved),
    ), refused


def revert(ledger: Ledger, ids: DataFrame, at: int) -> tuple[Ledger, DataFrame]:
    """The ledger after the reverts of the supersessions ``ids`` (id) at one instant, and the refused ones with the reason."""
    asked = ids.select("id").distinct().join(ledger.supersessions.select("id", "superseded", "via_id", "valid_to", F.lit(True).alias("there")), "id", "left")
    why = F.when(F.col("there").isNull(), "does not exist").when(F.col("valid_to").isNotNull(), "is not current").when(F.col("via_id").isNotNull(), F.concat(F.lit("was compressed by "), "via_id", F.lit("; revert that merge first")))
    asked = asked.withColumn("refused", why).checkpoint()
    good = asked.where("refused is null")
    now = F.lit(at).cast("bigint")
    rows = ledger.supersessions.join(good.select("id", F.lit(True).alias("closes")), "id", "left")
    rows = rows.join(good.select(F.col("id").alias("via_id"), F.col("superseded").alias("back_to")), "via_id", "left").checkpoint()
    over = F.col("valid_to").isNull() & (F.col("closes").isNotNull() | F.col("back_to").isNotNull())
    # The row that a compressed one replaced ended at the instant at which the compressed one began, and led to the item that comes back.
    again = rows.where(F.col("back_to").isNotNull() & F.col("valid_to").isNull()).select("superseded", F.col("back_to").alias("survivor"), F.col("valid_from").alias("valid_to"), F.lit(True).alias("opens"))
    state = rows.join(again, ["superseded", "survivor", "valid_to"], "left")
    ended = F.when(F.col("opens"), F.lit(None).cast("bigint")).when(over, now).otherwise(F.col("valid_to"))
    supersessions = state.select("id", "superseded", "survivor", "cause", "decision", "via_id", "valid_from", ended.alias("valid_to")).checkpoint()
    back = ledger.moves.join(good.select(F.col("id").alias("supersession_id")), "supersession_id", "left_semi")
    back = back.groupBy("kind", "row_id", F.col("to_item").alias("item_id")).agg(F.max_by("from_item", "at").alias("from_item"))
    dependents = ledger.dependents.join(back, ["kind", "row_id", "item_id"], "left").select("kind", "row_id", "owner", F.coalesce("from_item", "item_id").alias("item_id")).checkpoint()
    return replace(ledger, dependents=dependents, supersessions=supersessions), asked.where("refused is not null").select("id", "refused")


# documents as items: copies are merged into the first of their text, and some merges are taken back


def _copies(c: Catalog) -> tuple[Ledger, DataFrame]:
    ensure_checkpoints(c)
    docs = c.table("documents")
    items = docs.select(F.col("doc_id").alias("item_id"), F.coalesce("lang", F.lit("")).alias("kind"))
    rows = [c.table("labels").select(F.lit("labels").alias("kind"), F.col("doc_id").alias("row_id"), F.col("quality").cast("bigint").alias("owner"), F.col("doc_id").alias("item_id")), c.table("events").select(F.lit("events").alias("kind"), F.col("event_id").alias("row_id"), F.col("user_id").cast("bigint").alias("owner"), F.get_json_object("props", "$.k").cast("bigint").alias("item_id"))]
    ledger = Ledger.start(c.spark, items, reduce(DataFrame.unionByName, rows))
    texts = docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("survivor"))
    pairs = texts.join(first, "digest").where("doc_id != survivor").select(F.col("doc_id").alias("superseded"), "survivor", F.lit(CAUSES[1]).alias("cause"), F.lit("copies").alias("decision"))
    return merge(ledger, pairs, 1)


_LEDGER = """WITH f AS (SELECT text, min(doc_id) AS survivor FROM documents WHERE text IS NOT NULL GROUP BY 1), p AS (SELECT d.doc_id AS superseded, f.survivor, coalesce(d.lang, '') = coalesce(s.lang, '') AS ok, d.lang = 'de' AS back FROM documents d JOIN f ON d.text = f.text AND d.doc_id <> f.survivor JOIN documents s ON s.doc_id = f.survivor),
    dp AS (SELECT 'labels' AS kind, doc_id AS row_id, doc_id AS item_id FROM labels UNION ALL SELECT 'events', event_id, k FROM ev)"""


@query("i12_moved_dependents", f"{_LEDGER} SELECT kind, row_id, item_id AS from_item, survivor AS to_item, superseded || '>' || survivor || '@1' AS supersession_id FROM dp JOIN p ON p.superseded = dp.item_id WHERE ok")
def moved_dependents(c: Catalog) -> DataFrame:
    """The ledger after all copies of documents are merged into the first of their text; labels and events move along."""
    return _copies(c)[0].moves.select("kind", "row_id", "from_item", "to_item", "supersession_id")


@query("i13_dependents_after_reverts", f"{_LEDGER} SELECT kind, row_id, CASE WHEN ok AND NOT coalesce(back, false) THEN survivor ELSE item_id END AS item_id FROM dp LEFT JOIN p ON p.superseded = dp.item_id")
def dependents_after_reverts(c: Catalog) -> DataFrame:
    """Where labels and events point once the merges of German copies are taken back."""
    ledger, _ = _copies(c)
    german = c.table("documents").where("lang = 'de'").select(F.col("doc_id").alias("superseded"))
    ids = ledger.current().join(german, "superseded", "left_semi").select("id")
    return revert(ledger, ids, 2)[0].dependents.select("kind", "row_id", "item_id")
