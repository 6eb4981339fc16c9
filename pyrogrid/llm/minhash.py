"""Near-duplicate documents: min-max hashing of word shingles, links confirmed on full sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.llm.common import (
    Prefix,
    as_long,
    components,
    mix,
    row_key,
    table,
    text_bytes,
)
from pyrogrid.session import materialise

GROUP_BYTES = 1 << 18
# Longer words are hashed one by one, so that stretches of words stay short.
LONG_WORD = 256
BAND_ROWS = 6  # minimum and maximum under each of three permutations
MISS = 1e-5
NO_ID = -(2**63)


# ------------------------------------------------------------------------------ shingle sets


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the lower-cased words of a byte string, and where each starts."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out = np.zeros(len(starts), np.uint64)
    long_words = np.flatnonzero(ends - starts > LONG_WORD)
    for i in long_words:
        digest = hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    short = np.flatnonzero(ends - starts <= LONG_WORD)
    at = 0
    while at < len(short):  # stretches of bounded length, so a huge text needs no huge arrays
        lo = starts[short[at]]
        stop = max(at + 1, int(np.searchsorted(ends[short], lo + 4 * GROUP_BYTES, "right")))
        part = short[at:stop]
        sums = Prefix(low[lo : ends[part[-1]]])
        out[part] = sums.at(starts[part] - lo, ends[part] - lo)
        at = stop
    return out, starts


def combine(words: np.ndarray, n: int, width: int) -> np.ndarray:
    """Fingerprint of each run of ``width`` words; ``n`` tags runs of a short text."""
    count = len(words) - width + 1
    h = np.full(count, np.uint64(n), np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + count])
    return h


def shingle_sets(texts: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text; texts are hashed in groups."""
    out: list[np.ndarray] = []
    group: list[np.ndarray] = []
    held = 0
    space = np.array([32], np.uint8)

    def flush() -> None:
        nonlocal group, held
        if not group:
            return
        joined = np.concatenate([x for t in group for x in (t, space)])
        words, starts = word_hashes(joined)
        bounds = np.cumsum([len(t) + 1 for t in group])
        first = np.searchsorted(starts, np.concatenate([[0], bounds]))
        runs = combine(words, width, width) if len(words) >= width else words[:0]
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            n = hi - lo
            if n >= width:
                out.append(np.unique(runs[lo : hi - width + 1]))
            else:
                out.append(combine(words[lo:hi], n, n) if n else words[:0])
        group, held = [], 0

    for text in texts:
        if held + len(text) > GROUP_BYTES:
            flush()
        group.append(text)
        held += len(text)
    flush()
    return out


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return seeds[:n] | np.uint64(1), seeds[n:]


def min_max(values: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """Minimum and maximum under each of ``n`` permutations of each set: one hash serves both."""
    out = np.empty((len(firsts), 2 * n), np.uint64)
    for i, (factor, shift) in enumerate(zip(*permutations(n), strict=True)):
        h = values * factor + shift
        out[:, 2 * i] = np.minimum.reduceat(h, firsts)
        out[:, 2 * i + 1] = np.maximum.reduceat(h, firsts)
    return out


def band_count(threshold: float) -> int:
    """Bands that miss a pair of just this similarity with a probability below ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**BAND_ROWS))


def signatures(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """``_k, _h, n``, two fingerprints of the whole set, band hashes, one byte per signature value."""
    bands = band_count(threshold)
    perms = bands * BAND_ROWS // 2

    def rows(texts: list[np.ndarray]) -> Iterator[tuple]:
        sets = shingle_sets(texts, width)
        sizes = np.array([len(s) for s in sets])
        full = np.flatnonzero(sizes)
        sums = np.zeros((len(sets), 2), np.uint64)
        hashes = np.zeros((len(sets), bands), np.uint64)
        marks = np.zeros((len(sets), 2 * perms), np.uint8)
        if len(full):
            values = np.concatenate([sets[i] for i in full])
            firsts = np.cumsum(sizes[full]) - sizes[full]
            sums[full, 0] = np.add.reduceat(values, firsts)
            sums[full, 1] = np.add.reduceat(mix(values), firsts)
            found = min_max(values, firsts, perms)
            marks[full] = mix(found).astype(np.uint8)
            h = np.zeros((len(full), bands), np.uint64)
            for i in range(BAND_ROWS):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + found[:, i::BAND_ROWS])
            hashes[full] = h
        return sizes, sums, hashes, marks

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, sums, hashes, marks = [], [], [], []
            texts: list[np.ndarray] = []
            held = 0
            every = [*text_bytes(batch.column(2)), None]
            for text in every:
                if texts and (text is None or held + len(text) > 4 * GROUP_BYTES):
                    for to, x in zip((sizes, sums, hashes, marks), rows(texts), strict=True):
                        to.append(x)
                    texts, held = [], 0
                if text is not None:
                    texts.append(text)
                    held += len(text)
            n = np.concatenate(sizes).astype(np.int64)
            sums = as_long(np.concatenate(sums))
            flat = as_long(np.concatenate(hashes)).ravel()
            offsets = np.arange(0, len(flat) + 1, bands, dtype=np.int32)
            marks = np.concatenate(marks)
            body = np.arange(0, marks.size + 1, marks.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(n),
                    pa.array(np.ascontiguousarray(sums[:, 0])),
                    pa.array(np.ascontiguousarray(sums[:, 1])),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.BinaryArray.from_buffers(
                        pa.binary(), len(marks),
                        [None, pa.py_buffer(body.tobytes()), pa.py_buffer(marks.tobytes())],
                    ),
                ],
                ["_k", "_h", "n", "node", "check", "bands", "marks"],
            )

    keyed = docs.select(*row_key("doc_id", "text"), F.coalesce("text", F.lit("")).alias("text"))
    return keyed.mapInArrow(
        run, "_k long, _h long, n long, node long, check long, bands array<long>, marks binary"
    )


# ----------------------------------------------------------------------------- verified links


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures agree to within five standard deviations of the threshold."""
    values = BAND_ROWS * band_count(threshold)
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / values)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = [
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, values)
                for i in (2, 3)
            ]
            same = (sides[0] == sides[1]).mean(axis=1)
            yield batch.select([0, 1]).filter((same >= least).tolist())

    marks = classes.select("node", "marks")
    return (
        pairs.join(marks.toDF("a", "marks_a"), "a")
        .join(marks.toDF("b", "marks_b"), "b")
        .select("a", "b", "marks_a", "marks_b")
        .mapInArrow(run, "a long, b long")
    )


def class_texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``nodes`` with the text of one member of each class ``b``."""
    rep = classes.select(
        F.col("node").alias("b"), F.col("rep._k").alias("_k"), F.col("rep._h").alias("_h")
    )
    texts = docs.select(*row_key("doc_id", "text"), F.coalesce("text", F.lit("")).alias("text"))
    return nodes.join(rep, "b").join(texts, ["_k", "_h"])


def own_shingles(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``node, own``: how many shingles of each class no other one of ``nodes`` has.

    A batch sends each shingle once, and whether it saw it twice; a shingle with one row that was
    not seen twice belongs to the class on that row alone.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = shingle_sets([*text_bytes(batch.column(1))], width)
            owner = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            values, first, count = np.unique(every, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(values)), pa.array(owner[first]), pa.array(count > 1)],
                ["shingle", "node", "known"],
            )

    texts = class_texts(nodes.select(F.col("node").alias("b")).distinct(), classes, docs)
    rows = texts.select("b", "text").mapInArrow(run, "shingle long, node long, known boolean")
    once = rows.groupBy("shingle").agg(
        F.count("*").alias("c"), F.max("known").alias("known"), F.min("node").alias("node")
    )
    return once.where("c = 1 AND NOT known").groupBy("node").agg(F.count("*").alias("own"))


def confirmed(
    pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int
) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full sets.

    Each pair sends one text to the block of its first side, which sees that side's own text
    first; a side with many partners has many blocks of about 128.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / 128).alias("blocks"))
    asked = pairs.join(sizes, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.lit(1).alias("part")
    )
    own = asked.select("a", F.col("a").alias("b"), "block", F.lit(0).alias("part")).distinct()
    sent = (
        class_texts(asked.union(own), classes, docs)
        .select("a", "block", "part", "b", "text")
        .repartition("a", "block")
        .sortWithinPartitions("a", "block", "part")
    )

    def run(batches):
        import pyarrow as pa

        pivot, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            sets = shingle_sets([*text_bytes(batch.column(4))], width)
            for a, b, part, own in zip(
                batch.column(0).to_pylist(), batch.column(3).to_pylist(),
                batch.column(2).to_pylist(), sets, strict=True,
            ):
                if part == 0:
                    pivot, held = a, own
                    continue
                assert a == pivot
                both = len(np.intersect1d(held, own, assume_unique=True))
                if 100 * both >= percent * (len(held) + len(own) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

    return sent.mapInArrow(run, "a long, b long")


def first_spots(members: DataFrame, bands: int) -> DataFrame:
    """``node, spots``: its value in each band where it is a member."""
    found = members.groupBy("node").agg(
        F.map_from_entries(F.collect_list(F.struct("band", "value"))).alias("found")
    )
    every = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda band: F.coalesce(F.try_element_at("found", band), F.lit(NO_ID)),
    )
    return found.select("node", every.alias("spots"))


def tiled(
    members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, bands: int
) -> DataFrame:
    """Links between members of one bucket and different components, without rows for their pairs.

    A bucket is dealt into tiles of about ``TILE`` members, fewer where texts are long, and each
    two tiles meet in a group that holds their sets, so a member is sent once per tile and not once
    per partner.  Two members that share several buckets are compared in the first of them.
    """
    tiles = F.greatest(F.ceil(F.col("c") / TILE), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = (
        members.withColumn("tiles", tiles)
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .withColumn("other", other)
        .join(first_spots(members, bands), "node")
        .select(
            "band", "value", F.least("tile", "other").alias("low"),
            F.greatest("tile", "other").alias("high"), "tile", F.col("node").alias("b"), "label",
            "shared", "spots",
        )
    )
    group = ("band", "value", "low", "high")
    sent = (
        class_texts(dealt, classes, docs)
        .select(*group, "tile", "b", "label", "shared", "spots", "text")
        .repartition(*group)
        .sortWithinPartitions(*group, "tile", "b")
    )

    def links_of(band, same, tile, node, label, shared, spots, sets):
        size = np.array([len(s) for s in sets])
        for i in range(len(node)):
            j = np.arange(i + 1, len(node))
            both = np.minimum(shared[i], shared[j])
            fit = (label[j] != label[i]) & (100 * both >= percent * (size[i] + size[j] - both))
            if not same:
                fit &= tile[j] != tile[i]
            equal = (spots[j] == spots[i]) & (spots[i] != NO_ID)
            for k in j[fit & (equal.argmax(axis=1) == band)]:
                common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if 100 * common >= percent * (size[i] + size[k] - common):
                    yield min(node[i], node[k]), max(node[i], node[k])

    def run(batches):
        import pyarrow as pa

        def frame(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

        def ended():
            columns = [np.concatenate(x) for x in zip(*(part[:-1] for part in held), strict=True)]
            sets = [s for part in held for s in part[-1]]
            return links_of(key[0], key[2] == key[3], *columns, sets)

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            sets = shingle_sets([*text_bytes(batch.column(9))], width)
            keys = [batch.column(i).to_numpy() for i in range(4)]
            tile, node, label, shared = (batch.column(i).to_numpy() for i in range(4, 8))
            spots = batch.column(8).flatten().to_numpy().reshape(-1, bands)
            new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            edges = [0, *(np.flatnonzero(new) + 1), len(node)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(int(k[lo]) for k in keys)
                if held and now != key:
                    found.extend(ended())
                    held = []
                key = now
                part = slice(lo, hi)
                held.append((tile[part], node[part], label[part], shared[part], spots[part], sets[part]))
            yield frame(found)
        if held:
            yield frame([*ended()])

    return sent.mapInArrow(run, "a long, b long")


def fits(one: str, other: str, percent: int) -> F.Column:
    """Set sizes that allow the similarity."""
    return F.least(one, other) * 100 >= F.greatest(one, other) * percent


def links(classes: DataFrame, docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between set classes that reach all that are linked, and the components they make.

    In each round a bucket of equal band hashes compares one pivot with its members of other
    components; a pivot is then done.  After each round, members with so many shingles of
    their own that no other member can be similar enough go: texts that only share a passage, and
    copies with too many edits.  After ``ROUNDS`` rounds only members of still different
    components are compared, where the shingles that others have as well allow the similarity:
    pair by pair in buckets of at most ``PAIRED`` members, in tiles in larger ones.
    So no large bucket forms its pairs.  Left out are, beside what the bands miss, pairs with a
    pivot whose signatures agree less than the threshold by five standard deviations.
    """
    threshold = percent / 100
    exploded = classes.select("node", "n", F.posexplode("bands").alias("band", "value"))
    many = exploded.groupBy("band", "value").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    members = materialise(exploded.join(many, ["band", "value"]), "buckets")
    members = members.withColumn("shared", F.col("n"))
    found: list[DataFrame] = []
    tested: list[DataFrame] = []
    label = None
    for turn in range(ROUNDS + 1):
        if label is not None:
            members = members.drop("label").join(label, "node", "left").withColumn(
                "label", F.coalesce("component", "node")
            ).drop("component")
        else:
            members = members.withColumn("label", F.col("node"))
        open_ = (
            members.groupBy("band", "value")
            .agg(
                F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c"),
                F.sum("n").alias("total"),
                # Of those left, the one with the least of its own is nearest to all others.
                F.min(F.struct(1 - F.col("shared") / F.col("n"), "node", "n", "label")).alias("p"),
            )
            .where("low <> high")
            .select(
                "band", "value", F.col("p.node").alias("pivot"),
                F.col("p.n").alias("pivot_n"), F.col("p.label").alias("pivot_label"), "c", "total",
            )
        )
        members = materialise(members.join(open_, ["band", "value"]), "members")
        if turn < ROUNDS:
            pairs = members.where((F.col("label") != F.col("pivot_label")) & fits("n", "pivot_n", percent))
            pairs = pairs.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        else:
            large = materialise(members.where(F.col("c") > PAIRED), "large")
            small = members.where(F.col("c") <= PAIRED)
            side = small.select("band", "value", "node", "n", "label", "shared")
            both = F.least("x.shared", "y.shared")
            enough = both * 100 >= (F.col("x.n") + F.col("y.n") - both) * percent
            pairs = side.alias("x").join(side.alias("y"), ["band", "value"]).where(
                (F.col("x.label") < F.col("y.label")) & enough
            ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for done in tested:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        if turn < ROUNDS:  # the last pairs have passed the bound of shared shingles instead
            pairs = likely(pairs, classes, threshold)
        pairs = materialise(pairs, "pairs")
        good = confirmed(pairs, classes, docs, width, percent)
        if turn == ROUNDS:
            good = good.union(tiled(large, classes, docs, width, percent, band_count(threshold)))
        good = materialise(good, "links")
        tested.append(pairs)
        found.append(good)
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        label = materialise(components(every), "labels")
        if turn < ROUNDS:
            members = members.where("node <> pivot").select("band", "value", "node", "n", "shared")
            left = own_shingles(members, classes, docs, width)
            shared = F.col("n") - F.coalesce("own", F.lit(0))
            members = members.join(materialise(left, "own"), "node", "left").withColumn(
                "shared", shared
            ).drop("own").where(F.col("shared") * 100 >= F.col("n") * percent)
    return every, label


ROUNDS = 2
PAIRED = 16
TILE = 512
TILE_SHINGLES = 1 << 20  # 8 MB of a task


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, and its key ``_k, _h``.

    Texts are lower-cased (A-Z) and split at ASCII white space; a text shorter than ``width``
    words is one shingle.  Rows of equal sets are one class, represented by its smallest id.

    A null or empty text, or one without words, has an empty set and is linked with nothing.  Very
    long texts are hashed in stretches.  Repeated rows are copies of each other; a null id sorts
    first.  An empty table gives no rows; further columns of ``docs`` are ignored.
    """
    return grouped(docs, width, percent).drop("group")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """As ``near_duplicates``, with ``group``, which tells components of one smallest id apart.

    It is null for a row without shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = materialise(signatures(docs, width, percent / 100), "signed")
    classes = materialise(
        signed.where("n > 0").groupBy("node", "check", "n").agg(
            F.min(F.struct("_k", "_h")).alias("rep"),
            F.first("bands").alias("bands"), F.first("marks").alias("marks"),
        ),
        "classes",
    )
    _, label = links(classes, docs, width, percent)
    placed = classes.join(label, "node", "left").select(
        "node", "check", "n", F.coalesce("component", "node").alias("group"), "rep._k"
    )
    lowest = placed.groupBy("group").agg(F.min("_k").alias("component_id"))
    placed = placed.drop("_k").join(lowest, "group").select("node", "check", "n", "component_id", "group")
    component = F.coalesce("component_id", "_k")
    ident = F.nullif(F.col("_k"), F.lit(NO_ID))
    return (
        signed.select("_k", "_h", "n", "node", "check")
        .join(placed, ["node", "check", "n"], "left")
        .select(
            ident.alias("doc_id"), F.col("n").alias("n_shingles"),
            F.nullif(component, F.lit(NO_ID)).alias("component_id"),
            (F.col("_k") == component).alias("kept"), "_k", "_h", "group",
        )
    )


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id; columns unchanged.

    Of rows with that id the one with the smallest hash stays, so null and repeated ids keep one
    row of a group too.  Rows without words stay, repeated ones once.  An empty table gives no rows.
    """
    alone = F.when(F.col("group").isNull(), F.struct("_k", "_h"))
    kept = (
        grouped(docs, width, percent)
        .groupBy("group", alone.alias("alone"))
        .agg(F.min(F.struct("_k", "_h")).alias("first"))
        .select("first._k", "first._h")
    )
    row = F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row")
    joined = docs.select(row, *row_key("doc_id", "text")).join(kept, ["_k", "_h"])
    return joined.dropDuplicates(["_k", "_h"]).select("_row.*")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85).drop("_k", "_h")


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3
    THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y USING (g)
  WHERE x.doc_id <> y.doc_id GROUP BY ALL),
linked AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * c >= 85 * (s.n + t.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN linked l ON l.a = r.other),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
       d.doc_id = component_id AS kept
FROM documents d JOIN lowest USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
