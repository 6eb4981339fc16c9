"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pyrogrid.llm.common import row_key, table
from pyrogrid.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def apportion(parties: DataFrame, group: Sequence[str], name: str, weight: str) -> DataFrame:
    """``parties`` with ``quota``: its group's ``seats`` dealt by the highest quotients.

    The k-th seat of a party has quotient weight / (2k - 1).  With n parties, all seats that a
    divisor for ``seats - n/2`` gives are won and none beyond those for ``seats + n/2``, so only
    about 3n quotients are ranked, however many seats there are.  Ties go to the smaller name.
    """
    whole = Window.partitionBy(*group)
    total, n = F.sum(weight).over(whole), F.count("*").over(whole)

    def seats_at(shift: int) -> F.Column:
        share = F.col(weight) * F.greatest(F.col("seats") + shift * n / 2, F.lit(0)) / total
        return F.coalesce(F.floor(F.when(total > 0, share) + 0.5), F.lit(0)).cast("long")

    sure = parties.withColumn("sure", seats_at(-1)).withColumn("most", seats_at(1) + 1)
    sure = sure.withColumn("open", F.col("seats") - F.sum("sure").over(whole))
    quotients = sure.withColumn(
        "k", F.explode(F.sequence(F.col("sure") + 1, F.greatest("most", F.col("sure") + 1)))
    ).withColumn("quotient", F.col(weight) / (2 * F.col("k") - 1))
    rank = F.row_number().over(
        whole.orderBy(F.desc("quotient"), F.asc_nulls_last(name), F.asc("k"))
    )
    won = quotients.withColumn("won", (rank <= F.col("open")).cast("long"))
    rest = [c for c in parties.columns if c not in group and c != name]
    return won.groupBy(*group, name).agg(
        *[F.first(c).alias(c) for c in rest],
        (F.first("sure") + F.sum("won")).alias("quota"),
    )


def source_targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``sid, source, source_size, n_docs, target`` of each source.

    Weights repeat over the sources in code point order.  Targets share all words by weight and
    stop at ``most`` times the source; the level at which the rest stand follows from prefix sums
    over the sources by the level that would fill each.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sources.withColumn("sid", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn(
        "limit", F.col("source_size") * F.lit(most)
    )
    filled = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / open_weight)
    level = level.withColumn("full", F.col("limit") <= F.col("weight") * F.col("level"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "sid", "level")))
    level = level.withColumn("final", final.over(every)["level"])
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        F.col("weight") * F.col("final")
    )
    return level.select("sid", "source", "source_size", "n_docs", target.alias("target"))


def mix_counts(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = 3,
    block: int = 16,
    per_shard: int = 1000,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and the row's key, one row for each input row.

    Blocks of ``block`` words are dealt to the sources and, within each, to hashed shards of about
    ``per_shard`` documents, both by Sainte-Laguë.  A shard takes its quota from its documents in
    a seeded order, in whole rounds and then a part; no document is taken over ``most`` times.

    A null or empty text has size 0 and is never taken; the null source is a source of its own and
    comes last; repeated rows and null ids count as rows of their own; an empty table gives no
    rows; further columns of ``docs`` are ignored.  The order is a hash, so reruns agree.
    """
    sized = materialise(
        docs.select(
            F.col("doc_id").cast("long"), F.col("source").cast("string"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            *row_key("doc_id", "text", "source"),
        ),
        "sized",
    )
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    targets = source_targets(sources, weights, most)
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    quotas = apportion(targets.withColumn("seats", seats), [], "sid", "target").withColumn(
        "shards", F.ceil(F.col("n_docs") / per_shard)
    )
    quotas = materialise(quotas.withColumnRenamed("quota", "source_quota"), "quotas")
    known = quotas.select(
        "sid", F.col("source").alias("_source"), "shards", "source_size", "target", "source_quota"
    )
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards"))
    )
    shards = placed.groupBy("sid", "shard").agg(
        F.sum("size").cast("double").alias("words"), F.first("source_quota").alias("seats")
    )
    quota = F.least(F.col("quota") * block, F.col("words").cast("long") * most)
    shards = apportion(shards, ["sid"], "shard", "words").select(
        "sid", "shard", F.col("words").cast("long").alias("words"), quota.alias("quota")
    )
    inside = Window.partitionBy("sid", "shard").orderBy(
        F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "_h"
    )
    before = F.coalesce(
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    rounds = F.coalesce(F.expr("quota div nullif(words, 0)"), F.lit(0))
    part = F.col("quota") - rounds * F.col("words") - F.col("before")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part))
    return (
        placed.withColumn("before", before)
        .join(shards, ["sid", "shard"])
        .select(
            "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "_k", "_h"
        )
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as its words are taken, rounded to whole copies."""
    own = row_key("doc_id", "text", "source")
    copies = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    counts = (
        mix_counts(docs, **options)
        .groupBy("_k", "_h")
        .agg(F.max(copies).alias("_copies"))
        .where("_copies > 0")
    )
    row = F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row")
    return (
        docs.select(row, *own)
        .join(counts, ["_k", "_h"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("_row.*")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents")).drop("_k", "_h")
