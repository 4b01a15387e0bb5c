"""Mixing of sources to target sizes by entropy balancing.

The mix keeps as close to the data (in relative entropy of words) as the word counts wanted of
the sources allow. Such rates are exp(a source's multiplier); the multipliers minimise the convex dual,
sum of exp(multiplier) * words - multiplier * target, whose gradient and curvature are
sums over all documents, gathered anew for each Newton step. Rates become whole copies (0, 1 or 2) in blocks of
a source, from long documents to short: each takes the copies that bring the block's total
nearest to what the rates give so far, so a block ends within half a short document of it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents in a block of a source, about.
BLOCK = 2_000


#: Sources up to this number are sent to all executors, a short row each; more are joined by a shuffle.
SENT = 10_000


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, size, n) with rank from 0 in order of code points, null last; no task sorts more than a range of them."""
    null = F.col("source").isNull()
    own = common.cut_lineage(sources.repartitionByRange(common.partitions(sources.sparkSession), null, "source").sortWithinPartitions(null, "source").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = own.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    return own.withColumn("_part", part).join(F.broadcast(before), "_part").select("source", "size", "n", (F.col("_before") + F.col("_at") % (1 << 33)).alias("rank"))


def with_targets(sources: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sources (source, size, rank) with target: share of all sizes by weight, at most most times a source's size; what is above goes to the others by weight.

    All below the top get the same words a unit of weight. That price rises from round to round, as more sources are
    at the top, until it stays; each round is a sum over sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    own = sources.withColumn("_w", weight).withColumn("_top", F.lit(most) * F.col("size"))
    price = 0.0
    while True:
        at_top = F.col("_top") < F.lit(price) * F.col("_w")
        r = own.agg(F.sum("size").alias("all"), F.sum(F.when(at_top, F.col("_top"))).alias("fixed"), F.sum(F.when(~at_top, F.col("_w"))).alias("free")).first()
        now = (share * (r["all"] or 0) - (r.fixed or 0.0)) / r.free if r.free else price
        if now <= price:
            break
        price = now
    return own.withColumn("target", F.least(F.col("_top"), F.lit(price) * F.col("_w"))).drop("_w", "_top")


def size_of(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count(docs["text"], F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0))


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "source", F.xxhash64("text").alias("h"), size_of(docs).alias("size"))


def sent(sources: DataFrame, count: int) -> DataFrame:
    return F.broadcast(sources) if count <= SENT else sources


def multipliers(docs: DataFrame, sources: DataFrame, count: int, rounds: int = 50) -> DataFrame:
    """sources (source, target and more, of which there are count) with m, by Newton steps on the dual; each gathers gradient and curvature from docs (source, size). m is null without words."""
    now = sources.withColumn("m", F.when(F.col("target") > 0, F.lit(0.0)))
    mass = F.sum(F.col("size") * F.exp("m")).alias("_mass")  # the gradient is this less the target; the curvature is this
    for _ in range(rounds):
        of = now.select(F.col("source").alias("_of"), "m").where("m is not null")
        sums = docs.join(sent(of, count), docs["source"].eqNullSafe(of["_of"])).groupBy("_of").agg(mass)
        step = (F.col("target") - F.col("_mass")) / F.col("_mass")
        now = now.join(sent(sums, count), now["source"].eqNullSafe(sums["_of"]), "left").withColumn("_step", step)
        now = common.cut_lineage(now.withColumn("m", F.col("m") + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), "_step"))).drop("_of", "_mass"))
        if not (now.agg(F.max(F.abs("_step"))).first()[0] or 0.0) >= 1e-9:
            break
        now = now.drop("_step")
    return now.drop("_step")


def _mixed(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), size, source_size, target, taken of every row."""
    own = common.cut_lineage(with_sizes(docs))
    sources = ranked(own.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    sources = common.cut_lineage(with_targets(sources))
    count = sources.count()
    facts = multipliers(own, sources, count)
    facts = facts.select(F.col("source").alias("_of"), F.col("size").alias("source_size"), "target", F.coalesce(F.least(F.lit(MOST), F.exp("m")), F.lit(0.0)).alias("rate"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    rows = own.join(sent(facts, count), own["source"].eqNullSafe(facts["_of"])).drop("_of")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "h"), F.col("blocks")))

    def take(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values(["size", "doc_id", "h"], ascending=[False, True, True], kind="stable")
        rate, total, wanted, taken = float(of["rate"].iloc[0]), 0, 0.0, []
        for size in of["size"].to_numpy().tolist():
            wanted += rate * size
            copies = int(max(0, min(MOST, math.floor((wanted - total) / size + 0.5)))) if size else 0
            total += copies * size
            taken.append(copies * size)
        return of.assign(taken=np.array(taken, np.int64))[["doc_id", "h", "size", "source_size", "target", "taken"]]

    # a null id would turn the others into floats in pandas
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(common.NULL_ID)))
    out = rows.select("source", "block", F.col("id").alias("doc_id"), "h", "size", "source_size", "target", "rate").groupBy("source", "block").applyInPandas(take, "doc_id long, h long, size long, source_size long, target double, taken long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != common.NULL_ID, F.col("doc_id")))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times the copies) of every row.

    Null text has size 0 and takes 0; null sources are one source. Rows that repeat may get different
    copies, as many of each kind in every run. Sums of sources are a table; only if there are few is it sent to all executors. No rows: no rows.
    """
    return _mixed(docs).drop("h")


def digest(docs: DataFrame) -> DataFrame:
    """As mix."""
    return mix(docs)


def copies(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it. Rows without words are left out."""
    taken = _mixed(docs).where("taken > 0").select("doc_id", F.col("h").alias("_text"), (F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    # rows of one doc_id and text stand for each other: number them on both sides
    names = docs.columns
    left = docs.select(F.struct(*(docs[c] for c in names)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_t"), F.xxhash64(*(docs[c] for c in names)).alias("_h"))
    left = left.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_t").orderBy("_h")))
    right = taken.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_text").orderBy(F.desc("_copies"))))
    joined = left.join(right, left["_id"].eqNullSafe(right["doc_id"]) & (left["_t"] == right["_text"]) & (left["_n"] == right["_n"]))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_k")).select("_row.*")


#: Sizes and targets in DuckDB. Targets stop at the top in rounds, as above.
TARGETS = r"""with recursive d as (select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as size from documents),
s as (select source, sum(size) as size, [5, 2, 1][1 + (row_number() over (order by source is null, encode(source)) - 1) % 3] as w from d group by source),
p(k, price) as (select 0, 0.0::double union all select k + 1, (1.5 * (select sum(size) from s) - coalesce((select sum(2.0 * size) from s where 2.0 * size < p.price * w), 0)) / (select sum(w) from s where not 2.0 * size < p.price * w) from p where k < 60 and exists (select 1 from s where not 2.0 * size < p.price * w)),
t as (select source, size, least(2.0 * size, (select max(price) from p) * w) as target from s)
select doc_id, d.size, t.size as source_size, round(target, 6) as target from d join t on d.source is not distinct from t.source"""


def target_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target of the mix, rounded."""
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))
