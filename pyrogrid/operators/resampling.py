"""Bootstrap intervals of ROC metrics, by row or by whole patch.

Replicates are weights, not copies, and no draw is shuffled.  The score histogram is cut into value
ranges; a task goes through its range in descending order with one vector entry for each replicate,
and draws the counts of its cells, or of the patches it meets, by seeded binomial splitting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyrogrid.functions.multinomial import HELD_BYTES, LEAF, EqualCells, generator, interval_counts
from pyrogrid.functions.ordered import BUCKET, attach_by_value, cut_points, ordered_prefix, with_bucket
from pyrogrid.operators.metrics import roc_from_table, score_table
from pyrogrid.session import large_batches, materialise

# draw(replicate, j, n) -> index within [0, n)
DrawFn = Callable[[Column, Column, Column], Column]

# Cells whose replicate counts are in memory at a time.
CELLS = 512
# Cells and distinct scores that share one walk over the patches.
WALK_CELLS, WALK_SCORES = 1 << 18, 1 << 10
# A (score, label) cell is frequent above this part of all rows, so there are at most as many of them.
FREQUENT_CELLS = 1 << 20
# Draws that a task looks up at a time, entries of its table for that, and draws of a task.
LOOKED_UP, LOOKUP, TASK_DRAWS = 1 << 18, 1 << 18, 1 << 25
# Scores of one task of the row bootstrap, at most.
STRETCH = 1 << 17
CLASSES = ("pos", "neg")
SUMS = "rep long, n_pos double, n_neg double, wins double, gain double"


@dataclass(frozen=True)
class PlainDraw:
    """A draw by ``+``, ``*`` and ``%`` alone, which hold for columns and 64-bit arrays alike.

    Tasks draw its numbers themselves, a stretch at a time.
    """

    of: DrawFn

    def __call__(self, rep, j, n):
        return self.of(rep, j, n)


def hashed_draw(seed: int) -> DrawFn:
    return lambda rep, j, n: F.pmod(F.xxhash64(F.lit(seed), rep, j), n)


def draw_counts(spark, n_bootstrap: int, n: int, draw: DrawFn) -> DataFrame:
    """``rep, idx, m``: how often each replicate drew each of n indices, with replacement."""
    drawn = draw_numbers(spark, n_bootstrap, n, draw)
    return drawn.groupBy("rep", "idx").agg(F.count(F.lit(1)).alias("m"))


def draw_numbers(spark, n_bootstrap: int, n: int, draw: DrawFn) -> DataFrame:
    """``rep, idx``: the n draws of each replicate, with replacement."""
    rep, j = F.floor(F.col("id") / n), F.col("id") % n
    total = n_bootstrap * n
    parts = max(spark.sparkContext.defaultParallelism, min(n_bootstrap, -(-total // TASK_DRAWS)))
    return spark.range(0, total, 1, parts).select(rep.alias("rep"), draw(rep, j, F.lit(n)).alias("idx"))


def summarise(values: DataFrame, metric: str, level: float = 0.95) -> DataFrame:
    """Mean, percentile interval and number of the replicates in which both classes occur."""
    tail = (1.0 - level) / 2.0
    valid = values.where(~F.isnan(metric))
    row = valid.agg(
        F.avg(metric).alias("mean"),
        F.percentile(metric, tail).alias("lower"),
        F.percentile(metric, 1.0 - tail).alias("upper"),
        F.count(metric).alias("n_bootstrap"),
    )
    return row.select(
        *[c for c in row.columns if c != "n_bootstrap"],
        F.when(
            F.col("n_bootstrap") == 0,
            F.raise_error(F.lit("no replicate holds both classes")).cast("bigint"),
        )
        .otherwise(F.col("n_bootstrap"))
        .alias("n_bootstrap"),
    )


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class RocSums:
    """Sums of all replicates over cells that come in descending order of their score."""

    def __init__(self, pos: np.ndarray, neg: np.ndarray):
        """``pos`` and ``neg`` count what scores above the first cell."""
        self.pos, self.neg = pos.astype(np.float64), neg.astype(np.float64)
        self.wins, self.gain = np.zeros(len(pos)), np.zeros(len(pos))

    def add(self, pos: np.ndarray, neg: np.ndarray) -> None:
        """Cells x replicates, one cell for each distinct score."""
        above = self.pos + np.cumsum(pos, axis=0)
        raised = above + self.neg + np.cumsum(neg, axis=0)
        self.wins += (neg * (above - pos / 2)).sum(axis=0)
        self.gain += (pos * np.divide(above, raised, out=np.zeros_like(raised), where=raised > 0)).sum(axis=0)
        self.pos = above[-1]
        self.neg = raised[-1] - above[-1]


def _summed(found: DataFrame) -> DataFrame:
    """Metrics of each replicate from the sums of its ranges; NaN when a class is missing."""
    total = found.groupBy("rep").agg(
        *[F.max(c).alias(c) for c in ("n_pos", "n_neg")], *[F.sum(c).alias(c) for c in ("wins", "gain")]
    )
    defined = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    nan = F.lit(float("nan"))
    return total.select(
        "rep",
        F.when(defined, F.try_divide("wins", F.col("n_pos") * F.col("n_neg"))).otherwise(nan).alias("roc_auc"),
        F.when(defined, F.try_divide("gain", F.col("n_pos"))).otherwise(nan).alias("pr_auc"),
    )


def _lookup(starts: np.ndarray, ends: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Function from numbers below ``n`` to the range ``starts .. ends`` they are in, -1 for none.

    A table tells it for stretches of numbers that one range covers; others are searched for.
    """
    shift = max(0, (max(n, 1) - 1).bit_length() - (LOOKUP.bit_length() - 1))
    at = np.arange(((max(n, 1) - 1) >> shift) + 2, dtype=np.int64) << shift
    first = np.searchsorted(starts, at[:-1], side="right") - 1
    last = np.searchsorted(starts, at[1:] - 1, side="right") - 1
    first[first != last] = -2

    def find(numbers: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.full(len(numbers), -1)
        found = first[numbers >> shift]
        open_ = np.flatnonzero(found == -2)
        found[open_] = np.searchsorted(starts, numbers[open_], side="right") - 1
        found[numbers >= ends[found]] = -1
        return found

    return find


def _by_replicate(batches):
    """Replicate and numbers of stretches of Arrow batches of ``rep, idx``, long ones where they can be."""
    held, size, rep = [], 0, None
    for batch in batches:
        reps, idx = (batch.column(i).to_numpy() for i in (0, 1))
        edges = np.append(np.flatnonzero(np.append(True, reps[1:] != reps[:-1])), len(reps))
        for lo, hi in zip(edges[:-1], edges[1:]):
            if held and (reps[lo] != rep or size >= LOOKED_UP):
                yield rep, np.concatenate(held)
                held, size = [], 0
            rep = int(reps[lo])
            held.append(idx[lo:hi])
            size += hi - lo
    if held:
        yield rep, np.concatenate(held)


def _plain_stretches(spark, n_bootstrap: int, n: int, draw: PlainDraw):
    """Rows ``rep, lo, hi`` that stand for stretches of draws, and the function that draws them."""
    parts = max(1, -(-n // TASK_DRAWS))
    edges = [F.floor(F.lit(n) * (F.col("id") % parts + k) / parts).cast("long") for k in (0, 1)]
    rep = F.floor(F.col("id") / parts).cast("long")
    total = n_bootstrap * parts
    tasks_ = min(total, max(spark.sparkContext.defaultParallelism, -(-n_bootstrap * n // TASK_DRAWS)))
    stretches = spark.range(0, total, 1, tasks_).select(rep.alias("rep"), edges[0].alias("lo"), edges[1].alias("hi"))

    def numbers(batches):
        for batch in batches:
            for at, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for s in range(lo, hi, LOOKED_UP):
                    yield at, draw(at, np.arange(s, min(s + LOOKED_UP, hi), dtype=np.int64), n)

    return stretches, numbers


def _drawn_rows(rows, y, score, n_bootstrap, draw) -> DataFrame:
    """Metrics of each replicate whose draws the caller computes.

    Rows are numbered along (score, label), so a drawn number falls into the number range of one
    (score, label) cell.  What falls into the frequent cells is counted by the task that draws it, which
    knows their ranges.  The other draws look their cell up by an equi-join on blocks of numbers:
    uniform, hence even.  The counts are written, because their areas take several passes.
    """
    cells = materialise(ordered_prefix(rows, [score, y], {"n": F.lit(1)}), "cells")
    n = rows.count()
    end = F.col("n_below") + F.col("n")
    hot = F.col("n") * FREQUENT_CELLS > n
    frequent = cells.where(hot).select("n_below", "n").toPandas().sort_values("n_below")
    starts = frequent["n_below"].to_numpy(np.int64)
    ends = starts + frequent["n"].to_numpy(np.int64)
    if isinstance(draw, PlainDraw):
        drawn, numbers_of = _plain_stretches(rows.sparkSession, n_bootstrap, n, draw)
    else:
        drawn, numbers_of = draw_numbers(rows.sparkSession, n_bootstrap, n, draw), _by_replicate

    def count(batches):
        import pyarrow as pa

        find, rep, sums, waiting = _lookup(starts, ends, n), None, None, []

        def add():
            nonlocal sums, waiting
            if waiting:
                found = np.concatenate(waiting)
                sums += np.bincount(found[found >= 0], minlength=len(starts))
                waiting = []

        def out():
            add()
            some = np.flatnonzero(sums)
            return pa.RecordBatch.from_pydict(
                {"rep": np.full(len(some), rep), "n_below": starts[some], "m": sums[some]}
            )

        for at, numbers in numbers_of(batches):
            if at != rep:
                if rep is not None:
                    yield out()
                rep, sums = at, np.zeros(len(starts), np.int64)
            waiting.append(find(numbers))
            if len(waiting) * LOOKED_UP >= len(starts):
                add()
        if rep is not None:
            yield out()

    def rare(batches):
        import pyarrow as pa

        find = _lookup(starts, ends, n)
        for rep, numbers in numbers_of(batches):
            others = numbers[find(numbers) < 0]
            yield pa.RecordBatch.from_pydict({"rep": np.full(len(others), rep), "idx": others})

    found = (
        drawn.mapInArrow(count, "rep long, n_below long, m long")
        .groupBy("rep", "n_below")
        .agg(F.sum("m").alias("m"))
        .join(cells.where(hot).select("n_below", score, y), "n_below")
        .select("rep", score, y, "m")
    )
    if int((ends - starts).sum()) < n:
        spread_ = cells.where(~hot).select(
            score, y, "n_below", end.alias("end"),
            F.explode(F.sequence(F.floor(F.col("n_below") / 1024), F.floor((end - 1) / 1024))).alias("block"),
        )
        found = found.unionByName(
            drawn.mapInArrow(rare, "rep long, idx long")
            .withColumn("block", F.floor(F.col("idx") / 1024))
            .join(spread_.hint("merge"), "block")
            .where((F.col("idx") >= F.col("n_below")) & (F.col("idx") < F.col("end")))
            .groupBy("rep", score, y)
            .agg(F.count(F.lit(1)).alias("m"))
        )
    with large_batches(rows.sparkSession):
        weighted = materialise(found, "counts")
    return roc_from_table(score_table(weighted, y, score, by=["rep"], weight=F.col("m")), ["rep"])


def _split_rows(rows, y, score, n_bootstrap, seed) -> DataFrame:
    """Metrics of each replicate of a row bootstrap by multinomial splitting.

    The draws are first split between the classes, then down a tree over each class's rows in
    descending order of the score.  A task takes a stretch of scores and walks down to their
    rows; what the replicates hold above its stretch is another interval of the same tree.  The
    tree depends on the number of rows and the seed alone, so any layout gives the same counts.
    """
    table = materialise(score_table(rows.select(y, score), y, score), "scores")
    number = F.col("pos_below") + F.col("neg_below")
    most = F.least(
        F.lit(STRETCH), F.ceil((F.col("pos_total") + F.col("neg_total")) / (16 * tasks(rows)))
    )
    stretches = table.withColumn("stretch", F.floor(number / most).cast("long"))

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(score, ascending=False)
        sizes = [int(cell[f"{c}_total"].iloc[0]) for c in CLASSES]
        draws = np.full(n_bootstrap, sum(sizes), np.int64)
        n_pos = generator(seed).binomial(draws, sizes[0] / sum(sizes))
        drawn = (n_pos, draws - n_pos)
        counts = [cell[c].to_numpy(np.int64) for c in CLASSES]
        above = [sizes[k] - cell[f"{c}_below"].to_numpy(np.int64) - counts[k] for k, c in enumerate(CLASSES)]
        sums = None
        for s in range(0, len(cell), CELLS):
            some = []
            for k in (0, 1):
                first = above[k][s : s + CELLS]
                # Cells without rows of a class are empty intervals.
                edges = np.concatenate([[0], first, [first[-1] + counts[k][s : s + CELLS][-1], sizes[k]]])
                wide = np.append(True, np.diff(edges) > 0)
                found = np.zeros((len(edges) - 1, n_bootstrap), np.int64)
                if sizes[k]:
                    found[wide[1:]] = interval_counts(drawn[k], sizes[k], edges[wide], seed, k)
                some.append(found[:-1])
            if sums is None:
                sums = RocSums(some[0][0], some[1][0])
            sums.add(some[0][1:], some[1][1:])
        return pd.DataFrame(
            {"rep": np.arange(n_bootstrap), "n_pos": drawn[0], "n_neg": drawn[1], "wins": sums.wins, "gain": sums.gain}
        )

    stretches = stretches.repartition(tasks(rows), "stretch")
    return _summed(stretches.groupBy("stretch").applyInPandas(run, SUMS))


def bootstrap_metric(
    df: DataFrame,
    y: str,
    score: str,
    metric: str = "roc_auc",
    n_bootstrap: int = 1000,
    seed: int = 42,
    level: float = 0.95,
    draw: DrawFn | None = None,
) -> DataFrame:
    """Row bootstrap: as many draws with replacement as rows, for each replicate.

    Equal scores are one cell, so the work is replicates x distinct scores.  ``draw`` replaces
    the seeded splitting by single draws of row numbers along (score, label).
    """
    rows = df.dropna(subset=[y, score])
    if draw is None:
        values = _split_rows(rows, y, score, n_bootstrap, seed)
    else:
        values = _drawn_rows(rows, y, score, n_bootstrap, draw)
    return summarise(values, metric, level)


def _stretch_sums(counts: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts (classes x cells) times weights (cells x replicates), summed from each start to the next."""
    if len(starts) > 4:
        return np.stack([np.add.reduceat(c[:, None] * weight, starts) for c in counts])
    inside = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(weight))))
    spread = np.zeros((len(counts), len(starts), len(weight)))
    spread[:, inside, np.arange(len(weight))] = counts
    return spread @ weight.astype(np.float64)


def _walk(part: pd.DataFrame, cells: EqualCells | None, n_bootstrap: int) -> tuple[np.ndarray, np.ndarray]:
    """``pos`` and ``neg`` by distinct score and replicate of cells in order of their score.

    Cells are met patch by patch, so the counts of a patch are drawn once for all scores.
    """
    scores = part["score"].to_numpy()
    at = np.cumsum(np.append(False, scores[1:] != scores[:-1]))
    out = np.zeros((len(CLASSES), at[-1] + 1, n_bootstrap))
    counts = np.stack([part[c].to_numpy(np.float64) for c in CLASSES])
    given = part["m"].to_numpy() if "m" in part else None
    order, held = np.arange(len(part)), [0, len(part)]
    if given is None:
        idx = part["idx"].to_numpy(np.int64)
        drawn = np.unique(idx // LEAF)
        if len(drawn) > cells.most and cells.blocks > cells.most:
            order = np.argsort(idx // LEAF, kind="stable")
            held = np.searchsorted((idx // LEAF)[order], np.append(drawn[:: cells.most], drawn[-1] + 1))
    for turn, (lo, hi) in enumerate(zip(held, held[1:])):
        if given is None:
            cells.hold(drawn[turn * cells.most : (turn + 1) * cells.most])
        for s in range(lo, hi, CELLS):
            # Back in order of the score inside the block: sums over stretches of equal scores.
            block = np.sort(order[s : min(s + CELLS, hi)])
            weight = np.stack(given[block]) if given is not None else cells.weights(idx[block])
            starts = np.flatnonzero(np.append(True, at[block][1:] != at[block][:-1]))
            out[:, at[block][starts]] += _stretch_sums(counts[:, block], weight, starts)
    return out[0], out[1]


def _range_sums(placed: DataFrame, n_bootstrap: int, n: int, seed: int, pieces: int = 1) -> DataFrame:
    """``_bucket`` and the sums of each replicate over that value range.

    ``placed`` holds ``_bucket, score, pos, neg, idx`` of patch ``idx`` at a score, and ``m``,
    its multiplicities where the caller drew them.  A row with ``above`` opens its range: what the
    replicates hold of both classes above it.  Ranges are read as a stream, so a score that very
    many patches share needs no more memory.  The replicates are drawn in ``pieces``, each by tasks
    of its own, which remember the counts of all patches in their piece.
    """

    def run(batches):
        import pyarrow as pa

        cells, piece, lo_rep, hi_rep = None, None, 0, 0
        at, sums, last, held, kept, size, scores = None, None, None, None, [], 0, 0

        def settle():
            """Add the kept cells; the last score may go on, so it is held back."""
            nonlocal last, held, kept, size, scores
            if kept:
                part = pd.concat(kept, ignore_index=True)
                pos, neg = _walk(part, cells, hi_rep - lo_rep)
                if held is not None:
                    if part["score"].iloc[0] == last:
                        pos[0] += held[0]
                        neg[0] += held[1]
                    else:
                        sums.add(held[0][None], held[1][None])
                last, held = part["score"].iloc[-1], (pos[-1].copy(), neg[-1].copy())
                if len(pos) > 1:
                    sums.add(pos[:-1], neg[:-1])
                kept, size, scores = [], 0, 0

        def out():
            settle()
            if held is not None:
                sums.add(held[0][None], held[1][None])
            return pa.RecordBatch.from_pydict(
                {BUCKET: np.full(hi_rep - lo_rep, at[1], np.int32), "rep": np.arange(lo_rep, hi_rep), "n_pos": sums.pos,
                 "n_neg": sums.neg, "wins": sums.wins, "gain": sums.gain}
            )

        for batch in batches:
            frame = batch.to_pandas()
            keys = frame[["_piece", BUCKET]].to_numpy()
            edges = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            for lo, hi in zip(edges, [*edges[1:], len(frame)], strict=True):
                part = frame.iloc[lo:hi]
                if tuple(keys[lo]) != at:
                    if at is not None:
                        yield out()
                    at, last, held = tuple(keys[lo]), None, None
                    if at[0] != piece:
                        piece, cells = at[0], None  # the counts before go first
                        lo_rep, hi_rep = (n_bootstrap * (piece + k) // pieces for k in (0, 1))
                        if "m" not in part:
                            cells = EqualCells(n, hi_rep - lo_rep, seed if pieces == 1 else (seed, int(piece)))
                    zero = np.zeros(hi_rep - lo_rep)
                    sums = RocSums(zero, zero)
                first = part["above"].iloc[0] if "above" in part else None
                if first is not None:
                    above = np.asarray(first).reshape(2, n_bootstrap)[:, lo_rep:hi_rep]
                    sums = RocSums(above[0], above[1])
                    part = part.iloc[1:]
                while len(part):
                    value = part["score"].to_numpy()
                    new = np.cumsum(np.append(True, value[1:] != value[:-1]))
                    most = WALK_CELLS if "m" not in part else CELLS
                    room = min(most - size, int(np.searchsorted(new, WALK_SCORES - scores, side="right")))
                    if room > 0:
                        kept.append(part.iloc[:room])
                        size, scores = size + len(kept[-1]), scores + int(new[len(kept[-1]) - 1])
                        part = part.iloc[room:]
                    if len(part):
                        settle()
        if at is not None:
            yield out()

    # The work of a row is that of all replicates, so the number of tasks does not follow the bytes.
    head = [F.col("above").isNull()] if "above" in placed.columns else []
    piece = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))) if pieces > 1 else F.lit(0)
    ordered = (
        placed.withColumn("_piece", piece)
        .repartitionByRange(tasks(placed) * pieces, "_piece", BUCKET)
        .sortWithinPartitions("_piece", BUCKET, *head, F.desc("score"))
    )
    return ordered.mapInArrow(run, f"{BUCKET} int, {SUMS}")


def block_bootstrap(
    df: DataFrame,
    patch: str,
    y: str,
    score: str,
    metric: str = "roc_auc",
    n_bootstrap: int = 1000,
    seed: int = 42,
    level: float = 0.95,
    order: Column | None = None,
    draw: DrawFn | None = None,
) -> DataFrame:
    """Resample whole patches with multiplicity.

    What is shuffled is the histogram of (patch, score); a task turns it into a matrix of counts
    by replicate with the multiplicities of the patches it meets.  Wins over the
    negatives of other ranges follow from range totals; average precision, which is not linear in
    them, takes a second pass that starts each range with the totals above it.  With ``draw`` the
    multiplicities are the caller's and travel with the histogram.
    """
    rows = df.dropna(subset=[patch, y, score])
    hit = F.col(y) == 1
    hist = rows.groupBy(patch, score).agg(
        F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg")
    )
    hist = materialise(hist, "histogram")  # several passes read it
    sizes = hist.groupBy(patch).agg(F.count(F.lit(1)).alias("_cells"))
    keyed = sizes.withColumn("_order", F.xxhash64(patch) if order is None else order)
    index = ordered_prefix(keyed, ["_order", patch], {"n": F.lit(1), "_cells": F.col("_cells")})
    index = index.withColumnRenamed("n_below", "idx").select(patch, "idx", "_cells", "_cells_total")
    n = sizes.count()
    given = []
    if draw is not None:
        drawn = draw_counts(df.sparkSession, n_bootstrap, n, draw).groupBy("idx").agg(
            F.map_from_entries(F.collect_list(F.struct("rep", "m"))).alias("_by_rep")
        )
        every = F.sequence(F.lit(0).cast("bigint"), F.lit(n_bootstrap - 1).cast("bigint"))
        held = F.transform(every, lambda r: F.coalesce(F.try_element_at("_by_rep", r), F.lit(0).cast("bigint")))
        empty = F.array_repeat(F.lit(0).cast("bigint"), n_bootstrap)
        index = index.join(drawn, "idx", "left").withColumn(
            "m", F.when(F.col("_by_rep").isNull(), empty).otherwise(held)
        )
        index, given = index.drop("_by_rep"), ["m"]
    placed = with_bucket(
        attach_by_value(hist, index, patch, "_cells", "_cells_total"),
        score,
        cut_points(hist, score, least=tasks(df)),
    ).select(BUCKET, F.col(score).cast("double").alias("score"), "pos", "neg", "idx", *given)
    placed = materialise(placed, "histogram")
    # A task remembers the counts of all patches, so it draws them once for all its ranges.
    pieces = max(1, -(-n * n_bootstrap // HELD_BYTES)) if draw is None else 1
    found = _range_sums(placed, n_bootstrap, n, seed, pieces)
    if metric != "roc_auc":
        found = materialise(found, "ranges")  # the second pass reads it, too
    higher = W.partitionBy("rep").orderBy(F.desc(BUCKET)).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("rep")
    carried = found.select(
        BUCKET, "rep", "wins",
        F.sum("n_pos").over(whole).alias("all_pos"), F.sum("n_neg").over(whole).alias("all_neg"), "n_neg",
        *[F.coalesce(F.sum(c).over(higher), F.lit(0.0)).alias(f"above_{c}") for c in ("n_pos", "n_neg")],
    )
    if metric == "roc_auc":
        sums = carried.select(
            "rep", F.col("all_pos").alias("n_pos"), F.col("all_neg").alias("n_neg"),
            (F.col("wins") + F.col("n_neg") * F.col("above_n_pos")).alias("wins"), F.lit(None).cast("double").alias("gain"),
        )
        return summarise(_summed(sums), metric, level)
    # A list of structs gives a field's values in the order of the list.
    listed = [
        F.sort_array(F.collect_list(F.struct("rep", f"above_{c}"))).getField(f"above_{c}")
        for c in ("n_pos", "n_neg")
    ]
    heads = carried.groupBy(BUCKET).agg(F.concat(*listed).alias("above"))
    again = _range_sums(placed.unionByName(heads, allowMissingColumns=True), n_bootstrap, n, seed, pieces)
    totals = carried.groupBy("rep").agg(F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg"))
    sums = again.select("rep", "wins", "gain").join(totals, "rep")
    return summarise(_summed(sums), metric, level)
