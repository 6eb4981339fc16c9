"""Deduplication, tokens, packing, language and mixing against brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pyrogrid.llm import common, langid, line_dedup, minhash, mixing, packing, suffix_dedup, token_counts
from pyrogrid.llm.common import components
from tests.llm.conftest import CLASH, rows_of

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho "
         "sigma tau upsilon phi chi psi omega Élan naïve straße").split()  # fmt: skip


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "CHANGED"
    return [
        (0, base), (1, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "),
        (6, "one"), (7, "One"), (8, "two words"), (None, base + " tail"), (None, None),
        (9, "x" * 3000), (10, "ab" * 700), (11, prose(rng, 4000)), (12, "a\n" * 400),
        (13, base[50:400] + " other end"), (14, "tail " + base[-260:]), (15, "퟿ é" * 90),
    ]


# ------------------------------------------------------------------------------ repeated bytes


def brute_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 64])
def test_byte_dedup_is_brute_force(docs_of, odd_texts, length):
    found = suffix_dedup.byte_dedup(docs_of(odd_texts), length)
    got = rows_of(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    want = [(i, *x) for (i, _), x in zip(odd_texts, brute_bytes([t for _, t in odd_texts], length), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_long_text_in_blocks(docs_of, monkeypatch):
    rng = random.Random(5)
    shared = prose(rng, 200)
    texts = [prose(rng, 300) + shared + prose(rng, 250), shared[100:1000], "q" * 900, prose(rng, 90)]
    want = brute_bytes(texts, 100)
    small = suffix_dedup.Sampling(100)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 700)
    # The sampled windows of blocks are those of the whole text.
    import numpy as np

    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        starts = []
        for _, (at,), part, ends in suffix_dedup.groups(iter([data]), 100):
            _, low, high, gap, _ = small.rows(part, ends)
            for lo, hi, g in zip(low, high, gap, strict=True):
                if g and lo < (700 if len(data) > 500 else len(data)):
                    limit = 699 if len(data) > 500 else len(data)
                    starts += [at + s for s in range(lo, min(hi, limit) + 1)]
        assert sorted(starts) == list(range(max(0, len(data) - 99)))
    monkeypatch.undo()
    got = suffix_dedup.byte_dedup(docs_of(texts), 100).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == want


# ----------------------------------------------------------------------------- near duplicates


def shingle_set(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_near(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    ids = [-(2**63) if i is None else i for i, _ in rows]
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                low[root(i)] = root(j)
    least = defaultdict(lambda: 2**63)
    for i, ident in enumerate(ids):
        least[root(i)] = min(least[root(i)], ident)
    return [
        (rows[i][0], len(sets[i]), None if least[root(i)] == -(2**63) else least[root(i)],
         ids[i] == least[root(i)])
        for i in range(len(rows))
    ]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_are_brute_force(docs_of, odd_texts, width, percent):
    rng = random.Random(9)
    rows = list(odd_texts)
    seed = prose(rng, 150).split()
    for i in range(60):  # a large group around one text, some pairs of it above the limit only
        words = list(seed)
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, prose(rng, 30)) for i in range(40)]
    got = minhash.near_duplicates(docs_of(rows), width, percent).drop("_k", "_h")
    assert sorted(rows_of(got), key=repr) == sorted(brute_near(rows, width, percent), key=repr)


@pytest.mark.parametrize("paired,tile,shingles", [(1, 3, 1 << 18), (4, 64, 200), (0, 1, 1)])
def test_large_buckets_in_tiles_are_brute_force(docs_of, monkeypatch, paired, tile, shingles):
    for name, value in {"ROUNDS": 0, "PAIRED": paired, "TILE": tile, "TILE_SHINGLES": shingles}.items():
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(8)
    rows = []
    for _ in range(6):
        base = prose(rng, 120).split(" ")
        for _ in range(9):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randrange(7)):
                words[at] = f"w{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    got = rows_of(minhash.near_duplicates(docs_of(rows), 3, 80).select("doc_id", "n_shingles", "component_id", "kept"))
    assert sorted(got) == sorted(brute_near(rows, 3, 80))
    assert 6 < len({r[2] for r in got}) < len(rows)


def test_near_dedup_keeps_one_of_each_group(docs_of, odd_texts):
    docs = docs_of(odd_texts)
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 not in ids and 2 not in ids and ids.count(None) >= 1


def test_components(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 101), (101, 102), (5, 5)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


# ---------------------------------------------------------------------------------- line chunks


def test_line_dedup(docs_of):
    rng = random.Random(1)
    shared = [prose(rng, 6) for _ in range(30)]
    own = [[prose(rng, 5) for _ in range(7)] for _ in range(4)]
    rows = [(i, "\n".join([*own[i], *shared])) for i in range(4)]
    rows += [(9, None), (10, ""), (11, "single line"), (12, "single line"), (None, "\n".join(shared))]
    docs = docs_of(rows)
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert set(out[0].asDict()) == {*docs.columns, "n_lines", "n_removed", "n_spans"}
    whole = out[None]  # null ids sort first, so this occurrence stays
    assert whole["n_removed"] == 0 and whole["text"] == "\n".join(shared)
    for i in range(4):
        assert out[i]["n_lines"] == 37 and 15 < out[i]["n_removed"] < 37
        left = out[i]["text"].split("\n")
        assert left[:7] == own[i] and len(left) == 37 - out[i]["n_removed"]
    assert out[9]["text"] is None and out[9]["n_lines"] == 0
    assert out[10]["text"] == "" and out[11]["text"] == out[12]["text"] == "single line"


def test_line_dedup_finds_every_repeated_run(docs_of):
    rng = random.Random(5)
    bank = [prose(rng, 3) for _ in range(40)] + ["", "a"]
    rows = []
    for i in range(120):
        text = [prose(rng, 4) for _ in range(rng.randrange(4))]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(38)
            text[rng.randrange(len(text) + 1):0] = bank[at : at + rng.randrange(2, 5)]
        rows.append((i, "\n".join(text)))
    rows += [(200, "a\na\na\na"), (201, "x y\n" + rows[0][1] + "\nz"), (202, "\n\n\n")]
    first, firsts, want = {}, {}, {}
    for i, text in rows:
        lines, gone = text.split("\n"), set()
        for j, pair in enumerate(zip(lines, lines[1:])):
            at = first.setdefault(pair, (i, j))
            if at != (i, j):
                gone |= {j + 1} if at == (i, j - 1) else {j, j + 1}
        for j, line in enumerate(lines):
            assert firsts.setdefault(line, (i, j)) != (i, j) or j not in gone
        spans = sum(j - 1 not in gone for j in gone)
        left = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        want[i] = (left, len(lines), len(gone), spans)
    docs = docs_of(rows)
    out = line_dedup.line_dedup(docs).select("doc_id", "text", "n_lines", "n_removed", "n_spans")
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == want
    assert want[200][0] == "a\na" and sum(w[2] for w in want.values()) > 100
    # Two lines inside other text, without a chunk boundary between or around them.
    short = [(i, f"{prose(rng, 4)}\n{bank[0]}\n{bank[1]}\n{prose(rng, 4)}") for i in range(8)]
    left = line_dedup.line_dedup(docs_of(short)).where("n_removed = 2").count()
    assert left == 7


# ------------------------------------------------------------------------------- tokens, packing


def public_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_word_encoder_equals_tokenizer(odd_texts, monkeypatch):
    plain = public_tokenizer()
    texts = [t for _, t in odd_texts if t] + [
        "  a  b   c\n \n d", " x", " <|endoftext|>  <|endoftext|> z", "naïve,ü. déjà..,  ",
        "a b\x1c c  ", "don't, I'll. été's ... ,.", "tabs\t and \xa0 spaces ",
    ]
    for span in (1 << 20, 40):
        monkeypatch.setattr(packing.WordEncoder, "SPAN", span)
        for most in (3, 1000):
            encoder = packing.WordEncoder(packing.tokenizer_path(), most)
            for text in texts:
                ids = b"".join(encoder.encode(text))
                want = plain.encode(text, add_special_tokens=False).ids
                assert ids == b"".join(i.to_bytes(4, "little") for i in want)
            assert len(encoder) <= most


def test_marks_and_line_ends_do_not_reach_the_tokenizer_again(monkeypatch):
    plain = public_tokenizer()
    rng = random.Random(5)
    ends = [".\n", "\n", ",%%% ", "### ", "!! ", "'\n", "_ ", " ", "\n\n", "'s\n", ".\n1", "²\n", "\n."]
    names = [w + rng.choice("aeiou") for w in WORDS]
    texts = ["".join(rng.choice(names) + rng.choice(ends) for _ in range(300)) for _ in range(8)]
    for most in (3, 1000):
        encoder = packing.WordEncoder(packing.tokenizer_path(), most)
        for text in texts:
            want = plain.encode(text, add_special_tokens=False).ids
            assert b"".join(encoder.encode(text)) == b"".join(i.to_bytes(4, "little") for i in want)
    encoder = packing.WordEncoder(packing.tokenizer_path())
    calls = []
    whole = encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda text: calls.append(text) or whole(text))
    for text in texts:
        list(encoder.encode("".join(rng.choice(names) + rng.choice(ends[:8]) for _ in range(300)) + "end"))
    assert len(calls) <= len(texts) + 6  # a text's first word, and each mark once


def test_tasks_of_a_process_share_an_encoder():
    path = packing.tokenizer_path()
    assert packing.word_encoder(path) is packing.word_encoder(path)


def test_packing(docs_of, odd_texts):
    plain = public_tokenizer()
    out = packing.pack(docs_of(odd_texts)).collect()
    rows = Counter(i for i, _ in odd_texts)
    ids_of = {}
    for i, t in odd_texts:
        ids_of.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [0])
    total = sum(len(x) for v in ids_of.values() for x in v)
    assert sum(r["length"] for r in out) == total
    for r in out:
        whole = [x for x in ids_of[r["doc_id"]] if len(x) == r["doc_tokens"]]
        part = [x[r["start"] : r["start"] + r["length"]] for x in whole]
        crcs = [zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p)) for p in part]
        assert r["ids_crc32"] in crcs
    covered = Counter()
    for r in out:
        covered[r["doc_id"]] += r["length"]
    assert covered == {i: sum(len(x) for x in v) for i, v in ids_of.items()} and set(rows) == set(covered)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= total // 1000 + 2


def test_unigram_counts_equal_tokenizer(docs_of, odd_texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.vocabulary(token_counts.default_vocabulary())
    plain = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    rows = [*odd_texts, (50, "日本語 テスト\nabc\n\n x"), (51, "\n"), (52, " a  b "), (53, "\n\n a\n")]
    got = token_counts.token_counts(docs_of(rows), most=10)
    want = [(i, len(plain.encode(t or "", add_special_tokens=False).ids), len(t or "")) for i, t in rows]
    assert sorted(rows_of(got), key=repr) == sorted(want, key=repr)


def test_unigram_ties(spark):
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("b", -5.0), ("ab", -6.0), ("▁", -1.0)]
    plain = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    counter = token_counts.PieceCounter(pieces)
    for text in ["a" * n for n in range(1, 12)] + ["aab", "abab", "ba" * 4, "aaabaaab"]:
        assert counter.best(text) == len(plain.encode(text).ids), text


# -------------------------------------------------------------------------------------- language


def test_language_identification(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.identify(docs.withColumn("score", F.lit("x")), langid.fit(docs))
    held = found.where("crc32(string(doc_id)) % 4 = 2")
    n = held.count()
    assert n > 20 and held.where("lang = lang_pred").count() >= 0.95 * n
    assert found.where("score < 0 OR score > 1").count() == 0


def test_language_edges(docs_of):
    rows = [(i, t, lang, "a") for i, (t, lang) in enumerate(
        [("the house and the garden", "en"), ("das haus und der garten", "de")] * 6)]
    rows += [(50, None, "en", "a"), (51, "123 !?", None, "a"), (52, "", "de", "a"),
             (53, "the garden " * 60_000, None, "a"), (None, "und der", None, None)]
    model = langid.fit(docs_of(rows))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs_of(rows), model).collect()}
    assert out[50] == out[51] == out[52] == ("und", 0.0)
    assert out[53][0] == "en" and out[None][0] == "de" and out[1][0] == "de"
    kept = langid.keep_identified(docs_of(rows), model)
    assert kept.columns == docs_of(rows).columns and kept.count() == len(rows) - 3
    none = langid.fit(docs_of([(1, "text", None, "a")]))
    assert rows_of(langid.identify(docs_of(["abc"], clash=False), none).select("lang_pred", "score")) == [("und", 0.0)]


def test_grams_of_stretches_are_those_of_the_text(monkeypatch):
    import numpy as np

    text = "Straße über alles, naïve Élan. " * 9
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    monkeypatch.setattr(langid, "SPAN", 50)
    assert (np.sort(np.concatenate(list(langid.grams(text)))) == whole).all()


# ---------------------------------------------------------------------------------------- mixing


def targets_of(sizes, weights, most):
    """The rule as stated: stop at the limit, share the excess again by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing(docs_of):
    rng = random.Random(2)
    rows, ident = [], 0
    for source, n in [("b", 400), ("a", 30), ("C", 3), (None, 90), ("é", 60), ("", 20), ("zero", 2)]:
        for _ in range(n):
            rows.append((ident, "" if source == "zero" else prose(rng, rng.randrange(1, 90)), "en", source))
            ident += 1
    rows += [rows[5], rows[5], (None, prose(rng, 20), None, "a"), (9999, None, "en", "b")]
    out = mixing.mix_counts(docs_of(rows), per_shard=50).collect()
    size = {(r[0], r[3]): len((r[1] or "").split()) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size[r[0], r[3]]
    want = targets_of(sizes, (5, 2, 1), 3)
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"], s] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s, target in want.items():
        assert abs(taken[s] - target) <= 16 * 10 + 0.01 * target
    again = mixing.mix_counts(docs_of(rows[::-1]), per_shard=50).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    copies = mixing.mixed(docs_of(rows), per_shard=50)
    assert copies.columns == docs_of(rows).columns and copies.count() > 0


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(4)
    for n, seats in [(1, 7), (5, 0), (6, 3), (9, 100), (12, 1001)]:
        weights = [rng.choice([0.0, 1.0, rng.random() * 100]) for _ in range(n)]
        weights[0] = 50.0
        won = [0] * n
        for _ in range(seats):
            best = max(range(n), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        rows = [("g", i, w, seats) for i, w in enumerate(weights)]
        frame = spark.createDataFrame(rows, "g string, name int, w double, seats int")
        got = {r["name"]: r["quota"] for r in mixing.apportion(frame, ["g"], "name", "w").collect()}
        assert got == dict(enumerate(won))


# -------------------------------------------------------------------------------- empty tables


def test_empty_tables(docs_of):
    none = docs_of([])
    assert suffix_dedup.byte_dedup(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.near_dedup(none).count() == 0
    assert packing.pack(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert mixing.mix_counts(none).count() == 0 and mixing.mixed(none).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert set(CLASH) < set(none.columns)


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 100_000])
def test_words_of_regular_structure_do_not_collide(spark, docs_of, n):
    docs = docs_of([(1, thue_morse(n)), (2, thue_morse(n, 1)), (3, thue_morse(n) + " x y z"), (4, thue_morse(n))])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


@pytest.mark.parametrize("length", [1024, 5000])
def test_bytes_of_regular_structure_do_not_collide(docs_of, length):
    texts = [thue_morse(length) + "x", thue_morse(length, 1) + "y", "z" + thue_morse(length), "w" * 9]
    got = suffix_dedup.byte_dedup(docs_of(texts), length).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute_bytes(texts, length)


def test_fingerprints_are_polynomials_modulo_the_prime(monkeypatch):
    import numpy as np

    monkeypatch.setattr(common, "STRETCH", 100)
    data = np.random.default_rng(3).integers(0, 256, 450, dtype=np.uint8)
    for which, base in enumerate(common.BASES):
        sums = common.Prefix(data, which)
        lo, hi = np.array([0, 7, 99, 320]), np.array([450, 7, 301, 321])
        want = [
            sum((int(b) + 1) * pow(base, i, common.P) for i, b in enumerate(data[x:y])) % common.P
            for x, y in zip(lo, hi, strict=True)
        ]
        want = common.mix(np.array(want, np.uint64) + (hi - lo).astype(np.uint64))
        assert (sums.at(lo, hi) == want).all()
        starts = np.arange(len(data) - 39)
        assert (sums.runs(40) == sums.at(starts, starts + 40)).all()


def test_near_dedup_keeps_one_row_of_equal_ids(spark, docs_of):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:59], "other"])
    rows = [(None, " ".join(base)), (None, near), (5, "a b c d e f g"), (5, "quite another text of six words"),
            (6, " ".join(base)), (7, None), (8, "")]
    docs = docs_of(rows).selectExpr("*", "'x' AS `a.b`")
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert sum(t in (" ".join(base), near) for t in texts if t) == 1 and len(texts) == 5


def test_numbers_are_no_letters(spark, docs_of):
    rows = [(i, "the quick brown fox jumps over the dog", "en", "a") for i in range(40)]
    model = langid.fit(docs_of(rows))
    odd = docs_of([(1, "½ ² 12 _"), (2, "日本"), (3, "½a"), (4, None)])
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()}
    assert (got[1], got[4]) == ("und", "und") and got[2] != "und" and got[3] != "und"
    kept = langid.keep_identified(odd.selectExpr("*", "1 AS `a.b`"), model)
    assert 1 not in {r.doc_id for r in kept.collect()}
