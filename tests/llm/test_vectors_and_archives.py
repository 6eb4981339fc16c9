"""Vector operators against brute force, archives by exact round trip."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from pyrogrid.llm import embedding_dedup, topk, warc

VEC = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("class", T.StringType()),
        T.StructField("n_links", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VEC)


def some_vectors():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(160):
        rows.append((i, rng.normal(size=24).astype(np.float32).tolist(), int(i % 3)))
    base = rng.normal(size=24)
    for i in range(160, 240):
        noise = rng.normal(size=24) * 0.02 * (i % 9)
        rows.append((i, (base + noise).astype(np.float32).tolist(), 1 if i % 10 else 2))
    rows += [(240 + i, base.astype(np.float32).tolist(), 1) for i in range(20)]
    rows += [
        (300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] + [1.0] * 23, 1),
        (303, [float("inf")] + [1.0] * 23, 1), (304, [None] + [1.0] * 23, 1), (305, [], 1),
        (306, base.astype(np.float32).tolist(), None), (None, (2 * base).astype(np.float32).tolist(), 1),
        (320, [1.0, 2.0], 1), (340, [1.0, 2.0], 1), (7, rows[7][1], rows[7][2]),
    ]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_embedding_links_are_brute_force(spark):
    rows = some_vectors()
    n = len(rows)
    ids = [-(2**63) if r[0] is None else r[0] for r in rows]
    low = list(range(n))
    links = [0] * n

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if x is None or x != y or not (usable(a) and usable(b)) or len(a) != len(b):
                continue
            a, b = np.array(a, float), np.array(b, float)
            if a.any() and b.any() and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i] += 1
                links[j] += 1
                low[root(i)] = root(j)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), 2**63), ids[i])
    want = []
    for i, r in enumerate(rows):
        c = least[root(i)]
        want.append((r[0], links[i], None if c == -(2**63) else c, ids[i] == c))
    for tile in (16, 1024):
        got = embedding_dedup.near_vectors(frame(spark, rows), tile_rows=tile, sample_rows=50)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert embedding_dedup.near_vectors(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block,sample", [(16, 40), (4096, 1000)])
def test_top_k_is_brute_force(spark, block, sample):
    rows = some_vectors()
    rows += [(1000 + i, rows[3][1], 0) for i in range(30)]  # ties
    good = [(r[0], np.floor(np.array(r[1], float) * 64)) for r in rows if usable(r[1])]
    want, asked = set(), set()
    for q, a in good:
        if q is None or q % 20 or (q, len(a)) in asked:
            continue
        asked.add((q, len(a)))
        scores = [
            (-int(a @ b), -(2**63) if i is None else i) for i, b in good if i != q and len(a) == len(b)
        ]
        for k, (s, i) in enumerate(sorted(scores)[:20], 1):
            want.add((q, k, None if i == -(2**63) else i, -s))
    got = topk.top_k(frame(spark, rows), query_rows=8, block_rows=block, sample_rows=sample)
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert topk.top_k(frame(spark, [])).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(30, 50)) * 64, rng.normal(size=(40, 50)) * 64
    for m in topk.LEVELS:
        assert (topk.segments(a, m) @ topk.segments(b, m).T >= a @ b.T - 1e-6).all()


@pytest.mark.parametrize("chunk", [1 << 16, 700])
def test_archive_round_trip(spark, tmp_path, chunk):
    rng = random.Random(1)
    nasty = "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" * 60
    big = "".join(rng.choice("aé日\n\r ") for _ in range(5000))
    rows = [
        (1, "http://a/1", nasty), (2, "http://a/2", nasty), (9, None, nasty), (3, "u", big), (4, "u", big),
        (5, "x\r\ny", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (8, "u", ""),
        (10, "u", "z" * 999), (11, "u", "z" * 999), (12, "u", "w" * 1000), (13, "u", "w" * 1000),
        (None, "u", "w" * 1000), (14, "u", "WARC/1.1\r\nx"), (15, "u", "WARC/1.1" * 400), (15, "v", "WARC/1.1" * 400),
    ]
    schema = "page_id long, url string, html string, type string, record_id string, chunk int"
    pages = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], schema)
    got = warc.archived(pages, str(tmp_path / "a"), chunk=chunk).collect()
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = h in best and best[h] != (-1 if i is None else i)
        want.append((i, len(body), hashlib.sha1(body).hexdigest(),
                     "revisit" if again else "response", best[h] if again else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    chunks = warc.read_chunks(spark, str(tmp_path / "a"))
    assert chunks.where(f"n > {chunk}").count() == 0
    empty = warc.archived(pages.limit(0), str(tmp_path / "b"))
    assert empty.count() == 0


def test_scores_beyond_64_bits_are_refused():
    small = np.array([[3.0, -4.0]])
    assert topk.exact(small, small).tolist() == [[25]]
    big = np.full((1, 2), 64e8)
    with pytest.raises(OverflowError):
        topk.exact(big, big)
