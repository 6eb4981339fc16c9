"""Harmonic packing of tokenised documents into fixed-capacity sequences."""

from __future__ import annotations

import re
import string
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pyrogrid.llm.common import shard_count, table
from pyrogrid.session import materialise

CAPACITY = 1024
END_ID = 0
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, fits int"
)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """Ids of space-separated words by a byte-level BPE file, as little-endian bytes.

    The file's pre-tokeniser never joins across a single space between two visible characters, so
    a text may be cut there and each word's ids kept.  A key is a word without the space that
    precedes it.  At most ``most`` words stay in memory; others are encoded each time they occur.
    """

    SAFE = re.compile(r"(?<=\S) (?=\S)")
    ODD = re.compile(r"\s (?:\s|\Z)")
    SPAN = 1 << 20

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [
            t.content for t in self.tokenizer.get_added_tokens_decoder().values()
        ]
        self.most = most
        self.marks: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        self.line_end = self.whole("\n")
        self.letters = self._letters()
        self.of = self.__getitem__

    @staticmethod
    def _letters() -> list[str]:
        """Byte-level alphabet: visible Latin-1 bytes stand for themselves, others follow 255."""
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        return [chr(b) if b in own else chr(next(rest)) for b in range(256)]

    def _ids(self, ids) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def whole(self, text: str) -> bytes:
        return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters_only(self, core: str, space: str) -> bytes:
        letters = self.letters
        if core.isascii():
            spelled = letters[32] + core if space else core
        else:
            spelled = "".join([letters[b] for b in f"{space}{core}".encode()])
        return self._ids([t.id for t in self.model.tokenize(spelled)])

    def _mark(self, mark: str) -> bytes:
        got = self.marks.get(mark)
        if got is None:
            got = self.whole(mark)
            if len(mark) < 8 and len(self.marks) < self.most:
                self.marks[mark] = got
        return got

    def _start(self, word: str) -> bytes | None:
        """Ids of letters and the marks after them at the start of a line; None for other words."""
        got = self.starts.get(word)
        if got is None:
            core = word.rstrip(string.punctuation)
            if not core.isalpha():
                return None
            got = self._letters_only(core, "")
            if core != word:
                got += self._mark(word[len(core) :])
            if len(self) + len(self.starts) < self.most:
                self.starts[word] = got
        return got

    def _lines(self, word: str) -> bytes | None:
        """Ids of a word with line ends inside, each between two visible characters.

        Such a line end is a token of its own, so its neighbours are encoded apart and kept.
        """
        first, *others = word.split("\n")
        if not first.rstrip(string.punctuation).isalpha():
            return None
        out = [self.of(first)]
        for other in others:
            got = self._start(other)
            if got is None:
                return None
            out += (self.line_end, got)
        return b"".join(out)

    def __missing__(self, word: str) -> bytes:
        if "\n" in word:
            got = self._lines(word)
            if got is not None:
                return got  # seldom met again, and put together from kept words
        core = word.rstrip(string.punctuation)
        if core.isalpha():
            if core != word:  # a letter and a mark never share a token
                got = self.of(core) + self._mark(word[len(core) :])
            else:
                got = self._letters_only(core, " ")
        else:
            got = self.whole(f" {word}")
        if len(self) + len(self.starts) < self.most:
            self[word] = got
        return got

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text in stretches of about a million characters."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > self.SPAN:
                cut = self.SAFE.search(text, at + self.SPAN)
                end = cut.start() if cut else end
            part = text[at:end]
            if self.ODD.search(part) or any(s in part for s in self.special):
                words = self.SAFE.split(part)
            else:
                words = part.split(" ")
            if at:  # this part starts with the space it was cut at
                words = words[1:] if words[0] == "" else [words[0][1:], *words[1:]]
                yield b"".join(map(self.of, words))
            else:
                yield self.whole(words[0]) + b"".join(map(self.of, words[1:]))
            at = end


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a worker process: its words serve all tasks that the process runs."""
    return WordEncoder(path)


def cuts(length: int, capacity: int, slack: int, smallest: int) -> Iterator[tuple[int, int]]:
    """Piece lengths of a document, each with the number of such pieces that fill a sequence.

    A remainder stays whole where ``fits`` of them fill a sequence but for ``slack`` ids, or when
    it is shorter than ``smallest``; else a piece of exactly ``capacity // (fits + 1)`` is cut off.
    """
    for _ in range(length // capacity):
        yield capacity, 1
    rest = length % capacity
    while rest:
        fits = capacity // rest
        if rest < smallest or capacity - fits * rest <= slack:
            yield rest, fits
            return
        yield capacity // (fits + 1), fits + 1
        rest -= capacity // (fits + 1)


def tokenised(
    docs: DataFrame, path: str, capacity: int, slack: int, smallest: int
) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        encoder = word_encoder(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = b"".join([*encoder.encode(text), END_ID.to_bytes(4, "little")])
                at, total, doc = 0, len(ids) // 4, doc_id.as_py()
                for length, fits in cuts(total, capacity, slack, smallest):
                    crc = zlib.crc32(ids[4 * at : 4 * (at + length)])
                    out.append((doc, at, length, crc, total, fits))
                    at += length
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [*[pa.int64()] * 5, pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "fits"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, PIECES
    )


def fill_rest(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best fit, longest first, of the few pieces left over from unfilled bins of all classes."""
    rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
    room: dict[int, list[int]] = {}
    used: list[int] = []
    which, where = [], []
    for length in rows["length"]:
        fit = min((r for r, bins in room.items() if bins and r >= length), default=None)
        if fit is None:
            used.append(0)
            b = len(used) - 1
        else:
            b = room[fit].pop()
        which.append(b)
        where.append(used[b])
        used[b] += int(length)
        room.setdefault(capacity - used[b], []).append(b)
    return rows.assign(bin=which, offset=where)


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    slack: int = 8,
    smallest: int = 64,
    per_shard: int = 1000,
) -> DataFrame:
    """Pack every document's ids, then one end id, into sequences of at most ``capacity``.

    Remainders fall into reciprocal classes: in class ``fits`` exactly that many pieces fill a
    sequence, so a piece's sequence follows from its number within the class, which shards count
    independently.  Pieces after the last full bin of a class, fewer than ``fits`` for each, are a
    set bounded by ``capacity`` alone and are packed together by best fit.

    A null or empty text is the end id alone; a very long text is encoded in stretches and cut
    into full sequences; repeated rows are packed once each; a null id is kept; an empty table
    gives no rows; further columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    pieces = materialise(
        tokenised(docs, path or tokenizer_path(), capacity, slack, smallest), "pieces"
    )
    shards = shard_count(pieces.count(), per_shard)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)))
    by_class = Window.partitionBy("fits")
    before = by_class.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        pieces.groupBy("fits", "shard")
        .agg(F.count("*").alias("n"))
        .select(
            "fits",
            "shard",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
            F.floor(F.sum("n").over(by_class) / F.col("fits")).cast("long").alias("full"),
        )
    )
    # One row for each class, at most ``capacity`` of them.
    lower = Window.orderBy("fits").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        counted.groupBy("fits")
        .agg(F.first("full").alias("bins"))
        .select(
            "fits",
            F.coalesce(F.sum("bins").over(lower), F.lit(0)).alias("base"),
            F.sum("bins").over(Window.partitionBy()).alias("all_bins"),
        )
    )
    shard = Window.partitionBy("fits", "shard").orderBy("doc_id", "start")
    placed = (
        pieces.withColumn("number", F.row_number().over(shard) - 1)
        .join(counted, ["fits", "shard"])
        .join(F.broadcast(bases), "fits")
        .withColumn("number", F.col("number") + F.col("first"))
        .withColumn("bin", F.expr("number div fits"))
    )
    placed = materialise(placed, "placed")
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    bin_rows = (
        Window.partitionBy("sequence_id")
        .orderBy("number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    full = (
        placed.where("bin < full")
        .withColumn("sequence_id", F.col("base") + F.col("bin"))
        .withColumn("offset", F.coalesce(F.sum("length").over(bin_rows), F.lit(0)))
        .select(*keep, "sequence_id", "offset")
    )
    tail = placed.where("bin >= full").select(*keep, "all_bins")
    names = [f.name for f in tail.schema]

    def rest(group: pd.DataFrame) -> pd.DataFrame:
        done = fill_rest(group[names], capacity)
        done["sequence_id"] = done["all_bins"] + done["bin"]
        return done[[*keep, "sequence_id", "offset"]]

    schema = ", ".join(f"{c} long" for c in [*keep, "sequence_id", "offset"])
    # A constant number of rows (fewer than the sum of all ``fits``), so one group is bounded.
    tail = tail.groupBy(F.lit(0).alias("_all")).applyInPandas(rest, schema)
    return full.unionByName(tail)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
