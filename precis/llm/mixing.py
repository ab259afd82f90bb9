"""Mixing sources to target weights by Sainte-Lague apportionment.

The tokens of the mix are handed out in equal blocks. The quotient of a source is
its target over ``2 k + 1`` for its block number ``k`` = 0, 1, ...; the highest
quotients get the blocks. The blocks of a source go to its shards in the same
way, by their sizes. A shard takes its documents in a seeded order, over and over,
until its blocks are filled, so the last document may be taken in part.

Only quotients near the dividing line are listed: with weights ``w``, sum ``W`` and
``H`` blocks over ``n`` holders, the line lies between ``W / (H + n/2)`` and
``W / (H - n/2)``, so at most about ``2 n`` quotients are ranked however many blocks
there are.

A source has as many shards as the root of its documents, so neither a shard nor
the list of a source's shards grows with all its documents. All work is DataFrame
operations. The order is a hash of id and text, so reruns agree and equal rows
(same id, same text) are told apart by their count alone.

Null texts have size 0; a null source is a source of its own, placed last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, doc_words, kept_names, packed, unpacked

WEIGHTS = (3, 1, 2)
#: Words in a block.
BLOCK = 16
#: Share of all words that the mix takes.
BUDGET = 1.5
#: Times that a source may be taken, at most.
EPOCHS = 2
SEED = "mix-7"


def targets(sources: DataFrame) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: the budget shared by weight,
    no more than ``EPOCHS`` times the size, the excess shared again.

    Sources fill up in the order of ``cap / weight``. The first in that order whose
    share of what is left stays within its cap sets the level of all after it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = sources.withColumn("rank", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(EPOCHS))).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    ranked = ranked.withColumn("left", F.sum("source_size").over(whole) * F.lit(BUDGET) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("share", F.col("left") / F.sum("weight").over(after))
    fits = F.when(F.col("share") <= F.col("full_at"), F.struct("full_at", "rank", "share"))
    ranked = ranked.withColumn("level", F.min(fits).over(whole).getField("share"))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.select("source", "source_size", target.alias("target"))


def apportion(holders: DataFrame, group: list[str], holder: str, weight: str, house: str, limit: str) -> DataFrame:
    """Sainte-Lague within each ``group``: adds ``seats``. ``house`` is the group's
    number of seats (the same in all its rows), ``limit`` a holder's most seats. Equal
    quotients go by ``holder``."""
    key = group or [F.lit(1)]
    whole = Window.partitionBy(*key)
    sums = holders.withColumn("_w", F.sum(weight).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))

    def seats(house_size: Column) -> Column:
        share = F.col(weight) * F.greatest(house_size, F.lit(0.0)) / F.col("_w")
        return F.least(F.coalesce(F.floor(share + 0.5), F.lit(0)).cast("long"), F.col(limit))

    # one seat of slack on either side, for the rounding of the shares
    sums = sums.withColumn("_lo", F.greatest(seats(F.col(house) - F.col("_n") / 2) - 1, F.lit(0).cast("long")))
    sums = sums.withColumn("_hi", F.least(seats(F.col(house) + F.col("_n") / 2) + 1, F.col(limit)))
    given = sums.withColumn("_left", F.col(house) - F.sum("_lo").over(whole))
    # one row a listed quotient, and one (without a number) that holds the certain seats
    steps = F.when(F.col("_hi") > F.col("_lo"), F.sequence("_lo", F.col("_hi") - 1))
    listed = given.withColumn("_k", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce(steps, F.array().cast("array<long>")))))
    best = Window.partitionBy(*key, F.col("_k").isNull()).orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), F.col(holder).asc_nulls_last(), "_k")
    ranked = listed.withColumn("_at", F.row_number().over(best))
    won = F.col("_lo") + F.count(F.when(F.col("_k").isNotNull() & (F.col("_at") <= F.col("_left")), 1))
    return ranked.groupBy(*holders.columns, "_lo").agg(won.alias("seats")).drop("_lo")


def _order(doc_id: Column, text: Column) -> Column:
    """The seeded place of a document in its shard; its first digits choose the shard."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), own).cast("binary"))


def _shard(order: Column, shards: Column) -> Column:
    return F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), shards)


def _taken(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' narrow rows with ``passes`` and ``taken``, and the sources' rows."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        doc_words(text).alias("size"), _order(F.col("doc_id").cast("long"), text).alias("order"),
    )
    rows = cut(rows, "sizes")
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    shards_of = rows.groupBy("source").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("shards"))
    limit = F.ceil(F.col("source_size") * F.lit(float(EPOCHS)) / BLOCK).cast("long")
    blocks = F.floor(F.sum("target").over(Window.partitionBy(F.lit(1))) / BLOCK + 0.5).cast("long")
    quota = apportion(sources.withColumn("limit", limit).withColumn("house", blocks), [], "source", "target", "house", "limit")
    quota = quota.join(shards_of.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    quota = cut(quota.select("source", "source_size", "target", F.col("seats").alias("house"), "shards"), "quota")
    named = quota.withColumnRenamed("source", "_s")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("shard", _shard(F.col("order"), F.col("shards")))
    rows = cut(rows, "sharded")
    shard = rows.groupBy("source", "house", "shard").agg(F.sum("size").alias("shard_size"))
    shard = shard.withColumn("limit", F.ceil(F.col("shard_size") * F.lit(float(EPOCHS)) / BLOCK).cast("long"))
    shard = apportion(shard, ["source"], "shard", "shard_size", "house", "limit")
    words = F.least(F.col("seats") * BLOCK, F.col("shard_size") * EPOCHS)
    shard = cut(shard.select(F.col("source").alias("_s"), F.col("shard").alias("_d"), "shard_size", words.alias("quota")), "shards")
    rows = rows.join(shard, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_d")))
    turn = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(turn), F.lit(0))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long")
    rest = F.col("quota") - passes * F.col("shard_size") - before
    taken = passes * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(rest, "size"))
    return rows.withColumn("passes", passes).withColumn("taken", taken.cast("long")), quota


def mix(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken, source``."""
    return _taken(docs)[0].select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix: a row for every time that a document is taken, the
    last one cut after its words taken; columns as in ``docs``.

    A shard takes all its documents some times over and then, in its order, those
    before one place, so a document's share follows from its own place and its shard's
    row. Texts therefore meet the small tables of sources and shards only. Equal rows
    at a shard's last place share its words evenly.
    """
    rows, quota = _taken(docs)
    more = F.col("taken") - F.col("passes") * F.col("size")
    places = rows.groupBy("source", "shard", "passes", "order").agg(F.sum(more).alias("more"), F.count(F.lit(1)).alias("n"))
    last = F.max(F.when(F.col("more") > 0, F.struct("order", F.floor(F.col("more") / F.col("n")).cast("long").alias("words"))))
    shards = places.groupBy("source", "shard", "passes").agg(last.alias("last"))
    shards = cut(shards.select(F.col("source").alias("_s"), F.col("shard").alias("_d"), "passes", F.col("last.order").alias("_last"), F.col("last.words").alias("_last_words")), "places")
    text = F.col("text").cast("string")
    names = dict(zip(docs.columns, kept_names(docs.columns), strict=True))
    own = packed(docs, "text").withColumn("_source", F.col(names["source"]).cast("string"))
    own = own.withColumn("_order", _order(F.col(names["doc_id"]).cast("long"), text)).withColumn("_size", doc_words(text))
    of = quota.select(F.col("source").alias("_q"), "shards")
    own = own.join(of, F.col("_source").eqNullSafe(F.col("_q"))).withColumn("_shard", _shard(F.col("_order"), F.col("shards")))
    own = own.join(shards, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_d")))
    extra = F.when(F.col("_order") < F.col("_last"), F.col("_size")).when(F.col("_order") == F.col("_last"), F.col("_last_words")).otherwise(0)
    own = own.withColumn("_taken", F.col("passes") * F.col("_size") + extra).where("_taken > 0")
    turns = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_taken") / F.col("_size")).cast("long") - 1)
    both = own.withColumn("_words", F.explode(F.transform(turns, lambda k: F.least(F.col("_size"), F.col("_taken") - k * F.col("_size")))))
    word = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(word), F.lit(0)), F.lit(1), F.col("_words").cast("int")), "")
    whole = F.col("_words") >= F.col("_size")
    changed = {"text": F.when(whole, F.col("text")).otherwise(part)}
    if "n_chars" in docs.columns:
        length = F.length(part).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(whole, F.col(names["n_chars"])).otherwise(length)
    return both.select(*unpacked(docs.columns, changed))


#: The same rule in plain SQL: all quotients are listed and ranked.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS o
  FROM documents),
s AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w,
         source_size * 2.0::DOUBLE AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size, ceil(sqrt(count(*)))::BIGINT AS shards FROM d GROUP BY source)),
f AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM s),
t AS (
  SELECT *, least(cap, coalesce((SELECT arg_min(share, cap / w) FROM f WHERE share <= cap / w) * w, cap)) AS target FROM f),
q AS (
  SELECT source, count(*) AS house FROM (
    SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS place
    FROM t, LATERAL (SELECT unnest(generate_series(0, ceil(cap / {BLOCK})::BIGINT - 1)) AS k))
  WHERE place <= (SELECT floor(sum(target) / {BLOCK} + 0.5) FROM t) GROUP BY source),
r AS (
  SELECT d.*, t.source_size, t.target, coalesce(q.house, 0) AS house, ('0x' || substr(o, 1, 8))::BIGINT % t.shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source),
h AS (SELECT source, shard, any_value(house) AS house, sum(size)::BIGINT AS shard_size FROM r GROUP BY source, shard),
g AS (
  SELECT source, shard, count(*) AS seats FROM (
    SELECT source, shard, house, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS place
    FROM h, LATERAL (SELECT unnest(generate_series(0, ceil(shard_size * 2.0 / {BLOCK})::BIGINT - 1)) AS k))
  WHERE place <= house GROUP BY source, shard),
v AS (
  SELECT r.*, h.shard_size, least(coalesce(g.seats, 0) * {BLOCK}, h.shard_size * 2) AS quota,
         coalesce(sum(size) OVER (PARTITION BY r.source, r.shard ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source AND r.shard = h.shard
  LEFT JOIN g ON r.source IS NOT DISTINCT FROM g.source AND r.shard = g.shard)
SELECT doc_id, size, source_size, target,
       (CASE WHEN shard_size > 0 THEN (quota // shard_size) * size + greatest(0, least(quota % shard_size - before, size)) ELSE 0 END)::BIGINT AS taken
FROM v
"""
