"""Fill-in-middle transformation of texts held as seekable compressed frames."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.llm.common import table, text_bytes

MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
FRAME_BYTES = 1 << 16
ROWS_BYTES = 1 << 24


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Byte positions at which the code points of UTF-8 bytes start."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def slices(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Cuts of at most ``size`` bytes between code points."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        back = end
        while end < len(data) and back > max(at, end - 4) and (data[back] & 0xC0) == 0x80:
            back -= 1
        end = back if back > at else end
        yield data[at:end]
        at = end


class Codec:
    """Compressor and decompressor of one worker; each frame can be read without the others."""

    def __init__(self):
        import zstandard

        self._pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
        self.open = zstandard.ZstdDecompressor().decompress
        self._marks = {name: Frame(3, self._pack.compress(mark)) for name, mark in MARKS.items()}

    def frame(self, data: np.ndarray) -> Frame:
        return Frame(len(unit_starts(data)), self._pack.compress(data.tobytes()))

    def mark(self, name: str) -> Frame:
        return self._marks[name]


class Frame(tuple):
    """Number of units and compressed bytes."""

    def __new__(cls, units: int, body: bytes):
        return super().__new__(cls, (units, body))


class Store:
    """One text as independent frames with cumulative unit counts (units are code points)."""

    def __init__(self, frames: Iterable[Frame], codec: Codec):
        self.codec = codec
        self.bodies, self.ends = [], []
        at = 0
        for units, body in frames:
            at += units
            self.bodies.append(body)
            self.ends.append(at)

    @classmethod
    def of(cls, data: np.ndarray, codec: Codec, size: int = FRAME_BYTES) -> Store:
        return cls((codec.frame(part) for part in slices(data, max(size, 4))), codec)

    @property
    def n(self) -> int:
        return self.ends[-1] if self.ends else 0

    def read(self) -> Iterator[bytes]:
        """Bytes of the frames in order, one frame in memory at a time."""
        return map(self.codec.open, self.bodies)

    def select(self, lo: int, hi: int) -> Iterator[Frame]:
        """Frames of the units ``lo`` to ``hi``: whole ones as they are, cut ones opened."""
        i = bisect_right(self.ends, lo)
        while lo < hi:
            start = self.ends[i - 1] if i else 0
            stop = min(hi, self.ends[i])
            if start == lo and stop == self.ends[i]:
                yield Frame(stop - lo, self.bodies[i])
            else:
                data = np.frombuffer(self.codec.open(self.bodies[i]), np.uint8)
                at = np.append(unit_starts(data), len(data))
                at[0] = 0
                yield self.codec.frame(data[at[lo - start] : at[stop - start]])
            lo, i = stop, i + 1

    def holds_mark(self) -> bool:
        return next(self.marks(), None) is not None

    def marks(self) -> Iterator[tuple[int, str]]:
        """``(unit, name)`` of every mark in order; a mark may lie across frames."""
        names = {mark: name for name, mark in MARKS.items()}
        tail, at = b"", 0
        for body, end in zip(self.read(), self.ends, strict=True):
            text = tail + body
            found = text.find(b"<")
            while 0 <= found <= len(text) - 3:
                name = names.get(text[found : found + 3])
                if name:
                    ahead = np.frombuffer(text, np.uint8)[:found]
                    yield at - len(unit_starts(np.frombuffer(tail, np.uint8))) + len(unit_starts(ahead)), name
                found = text.find(b"<", found + 1)
            # The last two bytes may begin a mark; ends of a code point there begin none.
            tail, at = text[-2:], end

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.read():
            digest.update(part)
        return digest.hexdigest()


def plan(ident, n: int, marked: bool, seed: int, rate: int, spm: int) -> tuple[str, int, int]:
    """Form and the two cuts of a text of ``n`` units, from the hash of its id."""
    text = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    one, two, three, four = (int(text[i : i + 8], 16) for i in range(0, 32, 8))
    first, last = sorted((one % (n + 1), two % (n + 1)))
    if n == 0 or marked or three % 100 >= rate:
        return "plain", 0, n
    return "spm" if four % 100 < spm else "psm", first, last


def transformed(text: Store, form: str, first: int, last: int) -> Store:
    """The output of a text: its three parts behind their marks, in the order of the form."""
    if form == "plain":
        return text
    span = {"prefix": (0, first), "middle": (first, last), "suffix": (last, text.n)}

    def frames():
        for name in ORDERS[form]:
            yield text.codec.mark(name)
            yield from text.select(*span[name])

    return Store(frames(), text.codec)


def restored(output: Store, form: str) -> Store:
    """The text, rebuilt from an output and its form alone.

    A text that holds a mark stays plain, and no mark can arise where a part meets a mark, so the
    marks in an output are those that were put there.
    """
    if form == "plain":
        return output
    where = dict((name, at) for at, name in output.marks())
    stops = sorted([*where.values(), output.n])
    span = {name: (at + 3, stops[stops.index(at) + 1]) for name, at in where.items()}

    def frames():
        for name in ("prefix", "middle", "suffix"):
            yield from output.select(*span[name])

    return Store(frames(), output.codec)


ARCHIVE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, body binary, sizes array<long>, ends array<long>"


def _batches(rows: Iterable[tuple], schema, weight: int) -> Iterator:
    """Record batches bounded by the bytes of column ``weight``."""
    import pyarrow as pa

    def flush():
        columns = zip(*held, strict=True) if held else [[] for _ in schema]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight])
        if size >= ROWS_BYTES or len(held) >= 10_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def fill_in_middle(
    docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, frame_bytes: int = FRAME_BYTES
) -> DataFrame:
    """Outputs as seekable archives: ``doc_id, n, form, prefix_chars, middle_chars, body, sizes, ends``.

    A text is stored as independent zstandard frames of at most ``frame_bytes`` bytes with
    cumulative counts of code points.  Only frames that a cut falls into are opened; all others
    are carried into the output as they are.  ``body`` holds the output's frames one after the
    other (a zstandard stream that any reader opens), ``sizes`` their lengths and ``ends`` the
    units up to the end of each.

    ``rate`` in 100 texts are transformed, ``spm`` in 100 of them with the suffix first; the
    choice and the cuts follow from ``seed`` and the id.  A null text is empty; empty texts and
    texts that hold a mark stay plain, with null part lengths.  Null ids hash as no digits;
    rows of one id are cut alike, each on its own length; repeated rows are kept; an empty table
    gives no rows; further columns of ``docs`` are ignored.  Very long texts cost one frame of
    memory beside their compressed bytes; rows are independent, so nothing is shuffled.
    """

    def run(batches):
        import pyarrow as pa

        codec = Codec()
        longs = pa.list_(pa.int64())
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
             ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
             ("body", pa.binary()), ("sizes", longs), ("ends", longs)]
        )

        def rows():
            for batch in batches:
                for ident, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                    text = Store.of(data, codec, frame_bytes)
                    form, first, last = plan(ident, text.n, text.holds_mark(), seed, rate, spm)
                    out = transformed(text, form, first, last)
                    parts = (None, None) if form == "plain" else (first, last - first)
                    sizes = [len(b) for b in out.bodies]
                    yield ident, text.n, form, *parts, b"".join(out.bodies), sizes, out.ends

        yield from _batches(rows(), schema, 5)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ARCHIVE)


def _stores(batch, codec: Codec) -> Iterator[Store]:
    """The archives of a batch with the columns body, sizes and ends."""
    names = batch.schema.names
    body, sizes, ends = (batch.column(names.index(c)) for c in ("body", "sizes", "ends"))
    for data, size, end in zip(text_bytes(body), sizes.to_pylist(), ends.to_pylist(), strict=True):
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        units = np.diff([0, *end])
        frames = (
            Frame(int(u), data[lo:hi].tobytes())
            for u, lo, hi in zip(units, at[:-1], at[1:], strict=True)
        )
        yield Store(frames, codec)


def digests(archives: DataFrame) -> DataFrame:
    """``output_sha256`` of each output, and ``restored_sha256`` of the text rebuilt from it."""

    def run(batches):
        import pyarrow as pa

        codec = Codec()
        for batch in batches:
            kept = batch.select(["doc_id", "n", "form", "prefix_chars", "middle_chars"])
            forms = kept.column(2).to_pylist()
            pairs = [
                (out.sha256(), restored(out, form).sha256())
                for form, out in zip(forms, _stores(batch, codec), strict=True)
            ]
            one, two = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(one, pa.string()), pa.array(two, pa.string())],
                [*kept.schema.names, "output_sha256", "restored_sha256"],
            )

    schema = ARCHIVE.split(", body")[0] + ", output_sha256 string, restored_sha256 string"
    return archives.mapInArrow(run, schema)


def output_texts(archives: DataFrame) -> DataFrame:
    """``doc_id, form, text``: the outputs as plain strings."""

    def run(batches):
        import pyarrow as pa

        codec = Codec()
        for batch in batches:
            texts = [b"".join(out.read()) for out in _stores(batch, codec)]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in ("doc_id", "form")),
                 pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "form", "text"],
            )

    return archives.mapInArrow(run, "doc_id long, form string, text string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(fill_in_middle(table(spark, sf_dir, "documents")))


OP12_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
c AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a,
         ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS r, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS s
  FROM t),
f AS (
  SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 90
              THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c),
o AS (
  SELECT *, substr(t, 1, p) AS x, substr(t, p + 1, m) AS y, substr(t, p + m + 1) AS z FROM f)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
              ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""
