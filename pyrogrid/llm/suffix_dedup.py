"""Removal of repeated byte strings by fingerprints at sampled anchors, with one pairing step."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pyrogrid.llm.common import Prefix, as_long, row_key, table, text_bytes
from pyrogrid.session import discard, materialise

THRESHOLD = 200
GROUP_BYTES = 1 << 17
BLOCK_BYTES = 1 << 19
NO_ID = -(2**63)


class Sampling:
    """Which positions of a text take part, for repeats of ``length`` bytes.

    A window of ``length`` bytes is represented by the position whose string of ``gram`` bytes has
    the least fingerprint among its first ``width`` ones (the last of equal ones).  Position and
    the next sampled one lie in the window and depend on its bytes alone, so equal windows have
    equal samples at equal places.
    """

    def __init__(self, length: int):
        if length < 16:
            raise ValueError("repeats must have 16 bytes or more")
        self.length = length
        self.gram = min(length // 4, 64)
        self.width = min((length - self.gram + 1) // 2, 120)

    def least(self, grams: np.ndarray) -> np.ndarray:
        """Sampled position of each run of ``width`` strings."""
        n = len(grams)
        most = (1 << n.bit_length()) - 1
        places = np.uint64(most) - np.arange(n, dtype=np.uint64)
        low = (grams & ~np.uint64(most)) | places
        size = 1
        while size * 2 <= self.width:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        rest = self.width - size
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        return most - (low & np.uint64(most)).astype(np.int64)

    def rows(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sample position, first and last window start, distance to the next sample, fingerprint.

        A sample without windows of its own, which only follows another, has distance 0.

        ``data`` holds texts one after the other, which end at ``ends``.
        """
        if len(data) < self.length:
            return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
        grams = Prefix(data).runs(self.gram)
        chosen = self.least(grams)
        valid = np.ones(len(data), bool)
        for end in ends:
            valid[max(0, end - self.length + 1) : end] = False
        begins = np.concatenate([[0], ends[:-1]])
        for lo, hi in zip(begins, ends, strict=True):
            if hi - lo < self.length:
                valid[lo:hi] = False
        starts = np.flatnonzero(valid)
        if not len(starts):
            return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
        sample = chosen[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (sample[1:] != sample[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(starts)]]) - 1
        at = sample[first]
        distinct = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
        after = distinct[np.minimum(np.searchsorted(distinct, at) + 1, len(distinct) - 1)]
        more = np.setdiff1d(after, at)  # the last sample of a text is only the next one of another
        place = np.concatenate([at, more])
        low, high = (np.concatenate([starts[x], more]) for x in (first, last))
        return place, low, high, np.concatenate([after - at, 0 * more]), grams[place]


def groups(
    texts: Iterator[np.ndarray], length: int
) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """(text numbers, their offsets, bytes, ends): short texts joined, long ones in blocks.

    A block holds the first ``length`` bytes of the next one too.
    """
    numbers, pieces, held = [], [], 0

    def joined():
        data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
        return numbers, [0] * len(numbers), data, np.cumsum([len(p) for p in pieces])

    for i, text in enumerate(texts):
        if len(text) > GROUP_BYTES:
            for at in range(0, len(text), BLOCK_BYTES):
                part = text[at : at + BLOCK_BYTES + length]
                yield [i], [at], part, np.array([len(part)])
            continue
        if held + len(text) > GROUP_BYTES:
            yield joined()
            numbers, pieces, held = [], [], 0
        numbers.append(i)
        pieces.append(text)
        held += len(text)
    if numbers:
        yield joined()


def samples(docs: DataFrame, length: int) -> DataFrame:
    """``rank, spread, _k, _h, place``: the sampled positions of all texts, packed into longs.

    ``place`` holds the position, how far the first and last window start lie before it, and the
    distance to the next sample.  A string that a batch holds more than once is known to repeat:
    one row stands for it under its rank, the others are spread, so that a string in a third of
    all texts sends one row per batch to where ranks meet.
    """
    sampling = Sampling(length)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            out: list[tuple[np.ndarray, ...]] = []
            for numbers, offsets, data, ends in groups(text_bytes(batch.column(2)), length):
                at, low, high, gap, gram = sampling.rows(data, ends)
                if offsets[0] or len(data) > BLOCK_BYTES:  # windows of the overlap are the next block's
                    own = (low < BLOCK_BYTES) | (gap == 0)
                    at, low, high, gap, gram = (x[own] for x in (at, low, high, gap, gram))
                    high = np.where(gap == 0, high, np.minimum(high, BLOCK_BYTES - 1))
                which = np.searchsorted(ends, at, "right")
                begin = np.concatenate([[0], ends[:-1]])[which] - np.array(offsets)[which]
                place = (at - begin) << 24 | (at - low) << 16 | (at - high) << 8 | gap
                out.append((np.array(numbers)[which], place, gram))
            number, place, gram = (
                np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)
            )
            gram = gram.astype(np.uint64)
            _, first, inverse, count = np.unique(
                gram, return_index=True, return_inverse=True, return_counts=True
            )
            spread = np.where(count[inverse] > 1, np.arange(1, len(gram) + 1), 0)
            known = spread > 0
            spread[first] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(as_long(gram)), pa.array(spread.astype(np.int32)), pa.array(known),
                    pa.array(keys[0][number]), pa.array(keys[1][number]), pa.array(place.astype(np.int64)),
                ],
                ["rank", "spread", "known", "_k", "_h", "place"],
            )

    return docs.mapInArrow(
        run, "rank long, spread int, known boolean, _k long, _h long, place long"
    )


def ranked(docs: DataFrame, length: int) -> DataFrame:
    """``_k, _h, place, rank``: samples whose string, doubled to the next sample, occurs twice.

    First round: rows sorted by rank, unique ones go.  Second round: the rank is paired with that
    of the next sample of the same text, one sample further on; unique pairs go, and samples whose
    next one is gone cannot repeat.
    """
    same = Window.partitionBy("rank", "spread")
    first = samples(docs, length).withColumn("n", F.count("*").over(same))
    first = first.where("known OR n > 1").select("rank", "_k", "_h", "place")
    position = F.shiftright("place", 24)
    text = Window.partitionBy("_k", "_h").orderBy("place")
    # A sample may lie in two blocks of a long text and then has two rows; skip to the next place.
    after = F.array(*[F.struct(F.lead(position, i).over(text).alias("p"), F.lead("rank", i).over(text).alias("r")) for i in (1, 2, 3)])
    gap = F.col("place").bitwiseAND(255)
    found = F.filter("after", lambda x: x["p"] == position + gap)
    paired = (
        first.withColumn("after", after)
        .withColumn("next", F.try_element_at(found, F.lit(1))["r"])
        .where((gap > 0) & F.col("next").isNotNull())
        .select("_k", "_h", "place", F.xxhash64("rank", gap, "next").alias("rank"))
    )
    paired = materialise(paired, "pairs")
    twice = paired.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank")
    alive = materialise(paired.join(twice, "rank"), "ranks")
    discard(paired)
    return alive


def listed(column) -> Iterator[list[np.ndarray]]:
    """Fields of each row's list of structs of longs, without building Python objects."""
    flat = column.flatten()
    fields = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        yield [f[lo:hi] for f in fields]


def long_frame(names: str, columns: list[np.ndarray]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in columns], names.split()
    )


def stacked(out: list[tuple], n: int) -> list[np.ndarray]:
    return [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(n)]


STRETCH = "_k _h rank low high at f1 f2"
CELL = "_k _h rank low high single f1 f2"
CELL_WINDOWS = 8
WINDOW = "_k _h s single w1 w2"


def schema_of(names: str) -> str:
    return ", ".join(f"{c} long" for c in names.split())


def stretches(work: DataFrame, length: int) -> DataFrame:
    """All windows of a sample as one string, ``length`` bytes or more, with two fingerprints."""

    def run(batches):
        for batch in batches:
            k, h = (batch.column(i).to_numpy() for i in (0, 1))
            out = []
            for i, (text, (rank, place)) in enumerate(
                zip(text_bytes(batch.column(2)), listed(batch.column(3)), strict=True)
            ):
                at = place >> 24
                low, high = at - (place >> 16 & 255), at - (place >> 8 & 255)
                prints = [as_long(cut_prints(text, low, high + length, which)) for which in (0, 1)]
                full = [np.full(len(at), x[i]) for x in (k, h)]
                out.append((*full, rank, low, high, at, *prints))
            yield long_frame(STRETCH, stacked(out, 8))

    return work.select("_k", "_h", "text", "list").mapInArrow(run, schema_of(STRETCH))


def cut_prints(text: np.ndarray, low: np.ndarray, high: np.ndarray, which: int) -> np.ndarray:
    """Fingerprints of ``text[low:high]``, block by block of a long text."""
    out = np.zeros(len(low), np.uint64)
    order = np.argsort(low, kind="stable")
    at = 0
    while at < len(order):
        begin = low[order[at]]
        stop = int(np.searchsorted(low[order], begin + BLOCK_BYTES, "left"))
        part = order[at:stop]
        sums = Prefix(text[begin : high[part].max()], which)
        out[part] = sums.at(low[part] - begin, high[part] - begin)
        at = stop
    return out


def cells(work: DataFrame, length: int) -> DataFrame:
    """The listed stretches cut into cells of eight windows by their distance to the sample.

    The rank of a cell is the fingerprint of the bytes that all its windows share, whether or not
    the stretch has them all; so equal windows lie in cells of equal rank.
    """

    def run(batches):
        for batch in batches:
            k, h = (batch.column(i).to_numpy() for i in (0, 1))
            out = []
            for i, (text, (low, high, at, single)) in enumerate(
                zip(text_bytes(batch.column(2)), listed(batch.column(3)), strict=True)
            ):
                first, last = (at - high) // CELL_WINDOWS, (at - low) // CELL_WINDOWS
                size = last - first + 1
                which = np.repeat(np.arange(len(at)), size)
                number = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[which]
                top = at[which] - CELL_WINDOWS * number
                end = top - CELL_WINDOWS + 1
                rank = as_long(cut_prints(text, top, end + length, 0))
                lo, hi = np.maximum(low[which], end), np.minimum(high[which], top)
                prints = [as_long(cut_prints(text, lo, hi + length, n)) for n in (0, 1)]
                full = [np.full(len(lo), x[i]) for x in (k, h)]
                out.append((*full, rank, lo, hi, single[which], *prints))
            yield long_frame(CELL, stacked(out, 8))

    return work.select("_k", "_h", "text", "list").mapInArrow(run, schema_of(CELL))


def windows(work: DataFrame, length: int) -> DataFrame:
    """Every window of the listed stretches, with two fingerprints."""

    def run(batches):
        for batch in batches:
            k, h = (batch.column(i).to_numpy() for i in (0, 1))
            out = []
            for i, (text, (low, high, single)) in enumerate(
                zip(text_bytes(batch.column(2)), listed(batch.column(3)), strict=True)
            ):
                size = high - low + 1
                s = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                prints = [as_long(cut_prints(text, s, s + length, which)) for which in (0, 1)]
                full = [np.full(len(s), x[i]) for x in (k, h)]
                out.append((*full, s, np.repeat(single, size), *prints))
            yield long_frame(WINDOW, stacked(out, 6))

    return work.select("_k", "_h", "text", "list").mapInArrow(run, schema_of(WINDOW))


def cut_texts(work: DataFrame, length: int) -> DataFrame:
    """Each text without the listed windows: removed bytes, removed runs, digest and the rest."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            removed, spans, digests, rest = [], [], [], []
            for text, (low, high) in zip(text_bytes(batch.column(2)), listed(batch.column(3)), strict=True):
                step = np.zeros(len(text) + 1, np.int32)
                np.add.at(step, low, 1)
                np.add.at(step, high + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept = text[~gone].tobytes()
                digests.append(hashlib.sha256(kept).hexdigest())
                rest.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(digests), pa.array(rest, pa.binary())],
                ["_k", "_h", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return work.select("_k", "_h", "text", "list").mapInArrow(
        run,
        "_k long, _h long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )


def repeats(docs: DataFrame, length: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Texts that hold repeated windows, and ``_k, _h, low, high``: window starts that repeat.

    After the doubling rounds a sample's windows are taken as one stretch.  A stretch that occurs
    twice repeats with all its windows.  Where one rank has different stretches, as at the ends of
    a repeat, one representative of each stretch shows cells of eight windows, and where cells
    differ, their single windows.  So the interior of a repeat is one row per sample, not per byte.
    """
    texts = docs.select(*row_key("doc_id", "text"), F.coalesce("text", F.lit("")).alias("text"))
    alive = ranked(texts, length)
    lists = alive.groupBy("_k", "_h").agg(F.collect_list(F.struct("rank", "place")).alias("list"))
    work = materialise(texts.join(lists, ["_k", "_h"]), "texts")
    discard(alive)
    only = work.select("_k", "_h", "text")
    rows = materialise(stretches(work, length), "stretches")
    whole, shown, kinds = alike(rows.withColumn("single", F.lit(1).cast("long")), ["low", "high", "at"])
    discard(rows)
    # Of the stretches that differ from others of their rank, then of the cells that still do.
    rows = materialise(cells(only.join(shown, ["_k", "_h"]), length), "cells")
    discard(kinds)
    more, shown, kinds = alike(rows, ["low", "high"])
    discard(rows)
    seen = materialise(windows(only.join(shown, ["_k", "_h"]), length), "windows")
    discard(kinds)
    twice = seen.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.max("single").alias("some"))
    twice = twice.where("n > 1 AND some = 1").select("w1", "w2")
    parts = seen.where("single = 1").join(twice, ["w1", "w2"]).select(
        "_k", "_h", F.col("s").alias("low"), F.col("s").alias("high")
    )
    found = materialise(whole.unionByName(more).unionByName(parts).distinct(), "found")
    for done in (whole, more, seen):
        discard(done)
    return work, found


def alike(rows: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows whose string occurs twice, and per text the list of those to be looked at more closely.

    The latter are one representative of each string of a rank, where some string of it occurs
    once and others differ from it; ``single`` marks the strings that occur once.  The third frame
    is the written table that the list is made from.
    """
    kinds = materialise(
        rows.groupBy("rank", "f1", "f2").agg(
            F.count("*").alias("n"), F.max("single").alias("open"),
            F.min(F.struct("_k", "_h", *place)).alias("rep"),
        ).withColumn("single", ((F.col("n") == 1) & (F.col("open") == 1)).cast("long")),
        "kinds",
    )
    twice = kinds.where("n > 1 AND open = 1").select("rank", "f1", "f2")
    whole = rows.where("single = 1").join(twice, ["rank", "f1", "f2"]).select("_k", "_h", "low", "high")
    whole = materialise(whole, "whole")
    ends = (
        kinds.groupBy("rank").agg(F.count("*").alias("kinds"), F.max("single").alias("some"))
        .where("kinds > 1 AND some = 1").select("rank")
    )
    shown = kinds.join(ends, "rank").select("rep.*", "single")
    lists = shown.groupBy("_k", "_h").agg(F.collect_list(F.struct(*place, "single")).alias("list"))
    return whole, lists, kinds


def byte_dedup(docs: DataFrame, length: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row.

    Each byte of a text's UTF-8 form that lies in a string of ``length`` bytes which also starts
    anywhere else, in the same text or another, is removed; strings are judged on the input.
    ``kept`` is the rest as bytes, null where nothing was removed.

    A null or empty text has no bytes and a text shorter than ``length`` loses none; long texts
    are sampled in overlapping blocks; repeated rows repeat each other and so lose all windows;
    null ids are kept; an empty table gives no rows; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    work, low_high = repeats(docs, length)
    lists = low_high.groupBy("_k", "_h").agg(F.collect_list(F.struct("low", "high")).alias("list"))
    texts = work.select("_k", "_h", "text")
    cut = materialise(cut_texts(texts.join(lists, ["_k", "_h"]), length), "cut")
    for done in (work, low_high):
        discard(done)
    cut = cut.dropDuplicates(["_k", "_h"])
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        *row_key("doc_id", "text"), F.octet_length(body).cast("long").alias("n_bytes"),
        F.sha2(body, 256).alias("sha"),
    )
    return rows.join(cut, ["_k", "_h"], "left").select(
        F.nullif("_k", F.lit(NO_ID)).alias("doc_id"), "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept",
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup(table(spark, sf_dir, "documents")).drop("kept")
