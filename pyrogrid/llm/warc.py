"""WARC archives as a chunked record table: large payloads are segmented, never held whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.llm.common import row_key, table
from pyrogrid.session import materialise, scratch_path

VERSION = "WARC/1.1"
END = "\r\n\r\n"
CHUNK = 1 << 16
LEAST = 1000
NO_ID = -(2**63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: str, mark: str) -> F.Column:
    return F.concat(F.lit("urn:page:"), F.col(page), F.lit(":"), F.col(mark))


def decisions(pages: DataFrame, least: int) -> DataFrame:
    """``_k, _h, payload_digest, refers_to`` (a record id, for revisits) of each distinct row.

    Payloads are compared by digest and length; the largest page id of those with ``least`` bytes
    or more is the response.  The maximum is pre-aggregated, so one payload may fill the table.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        *row_key("page_id", "html"), F.sha1(payload).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("n"),
    ).distinct()
    rows = materialise(rows, "digests")
    kept = (
        rows.where(F.col("n") >= least)
        .groupBy("payload_digest", "n")
        .agg(F.max(F.struct("_k", "_h")).alias("best"), F.count("*").alias("c"))
        .where("c > 1")
        .drop("c")
    )
    joined = rows.join(kept, ["payload_digest", "n"], "left")
    other = F.col("best._k") != F.col("_k")
    return joined.select(
        "_k", "_h", "payload_digest",
        F.when(other, record_id("best._k", "best._h")).alias("refers_to"),
    )


def parts(payload: bytes, chunk: int) -> Iterator[bytes]:
    """Stretches of at most ``chunk`` bytes, cut between characters and inside version strings.

    So every stretch is valid UTF-8 and none holds what separates records in the archive.
    """
    at, mark = 0, VERSION.encode()
    while True:
        end = min(len(payload), at + chunk)
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        found = payload.find(mark, at, end + len(mark) - 1)
        if found >= 0:
            end = min(end, found + 4)
        yield payload[at:end]
        at = end
        if at >= len(payload):
            return


def records(batches, chunk: int, date: str):
    """Archive text of each page: one record, with continuation records for further chunks."""
    import pyarrow as pa

    for batch in batches:
        out = []
        names = batch.schema.names
        columns = [batch.column(names.index(c)) for c in ("id", "url", "digest", "refers_to", "html")]
        for ident, url, digest, refers, html in zip(*columns, strict=True):
            ident, refers = ident.as_py(), refers.as_py()
            url = "".join((url.as_py() or "").split())
            common = [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest.as_py()}"]
            if url:
                common.append(f"WARC-Target-URI: {url}")
            if refers is not None:
                head = [f"{VERSION}", "WARC-Type: revisit", f"WARC-Record-ID: <{ident}>", *common]
                head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers}>", "Content-Length: 0"]
                out.append("\r\n".join(head) + END)
                continue
            payload = (html.as_py() or "").encode()
            total = 0
            pieces = parts(payload, chunk)
            for number, body in enumerate(pieces, 1):
                total += len(body)
                last = total == len(payload)
                if number == 1:
                    head = [VERSION, "WARC-Type: response", f"WARC-Record-ID: <{ident}>", *common]
                    if not last:
                        head.append("WARC-Segment-Number: 1")
                else:
                    head = [VERSION, "WARC-Type: continuation", f"WARC-Record-ID: <{ident}:{number}>"]
                    head += [f"WARC-Date: {date}", f"WARC-Segment-Origin-ID: <{ident}>"]
                    head.append(f"WARC-Segment-Number: {number}")
                    if last:
                        head.append(f"WARC-Segment-Total-Length: {total}")
                head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
                out.append("\r\n".join(head) + END + body.decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_archives(
    pages: DataFrame,
    path: str,
    least: int = LEAST,
    chunk: int = CHUNK,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write a record for each distinct row of ``pages`` (page_id, url, html) as gzip archives."""
    decided = decisions(pages, least)
    rows = pages.select("url", "html", *row_key("page_id", "html")).dropDuplicates(["_k", "_h"])
    rows = rows.join(decided, ["_k", "_h"]).select(
        record_id("_k", "_h").alias("id"), F.col("url").cast("string").alias("url"),
        F.col("payload_digest").alias("digest"), "refers_to",
        F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"),
    )
    text = rows.mapInArrow(lambda batches: records(batches, chunk, date), "value string")
    text.write.option("lineSep", END).option("compression", "gzip").text(path)


CHUNKS = (
    "record_id string, chunk int, type string, refers_to string, stated string, "
    "segmented boolean, total long, n long, sha1 string, data binary"
)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives: record id, chunk number and bytes, in streams of short rows.

    A chunk that is a record of its own comes with its digest instead of its bytes.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for value in batch.column(0):
                head, found, body = value.as_py().partition(END)
                if not found:
                    continue
                lines = [x.partition(": ") for x in head.split("\r\n")]
                field = {k: v.strip("<>") for k, _, v in lines}
                body = body.encode()[: int(field["Content-Length"])]
                if len(body) != int(field["Content-Length"]):
                    raise ValueError(f"cut record {field['WARC-Record-ID']}")
                segmented = "WARC-Segment-Number" in field
                out.append((
                    field.get("WARC-Segment-Origin-ID", field["WARC-Record-ID"]),
                    int(field.get("WARC-Segment-Number", 1)), field["WARC-Type"],
                    field.get("WARC-Refers-To"),
                    field.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, segmented,
                    int(field.get("WARC-Segment-Total-Length", 0)) or None, len(body),
                    None if segmented else hashlib.sha1(body).hexdigest(),
                    body if segmented else None,
                ))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(),
                     pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = [x.split()[0] for x in CHUNKS.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names
            )

    lines = spark.read.option("lineSep", f"{END}{VERSION}\r\n").text(path)
    return lines.mapInArrow(run, CHUNKS)


RECORDS = "record_id string, type string, refers_to string, payload_bytes long, payload_digest string"


def digest_chunks(chunks: DataFrame) -> DataFrame:
    """Records whose chunks are hashed one after the other; no record is held whole."""

    def run(batches):
        import pyarrow as pa

        ident, state, size, total, stated, number = None, None, 0, None, None, 0

        def ended():
            if total != size or state.hexdigest() != stated:
                raise ValueError(f"record {ident} does not match its digest or length")
            return ident, "response", None, size, state.hexdigest()

        def frame(out):
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            names = [x.split()[0] for x in RECORDS.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names
            )

        for batch in batches:
            out = []
            for name, chunk, said, last, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != ident:
                    if ident is not None:
                        out.append(ended())
                    ident, state, size, total, stated, number = name, hashlib.sha1(), 0, None, said, 0
                number += 1
                if chunk != number:
                    raise ValueError(f"record {ident} misses chunk {number}")
                state.update(body)
                size += len(body)
                total = last or total
            yield frame(out)
        if ident is not None:
            yield frame([ended()])

    ordered = (
        chunks.select("record_id", "chunk", "stated", "total", "data")
        .repartition("record_id")
        .sortWithinPartitions("record_id", "chunk")
    )
    return ordered.mapInArrow(run, RECORDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives: ``record_id, type, refers_to, payload_bytes, payload_digest``.

    A revisit has the length and digest of the response that it refers to.
    """
    chunks = materialise(read_chunks(spark, path), "chunks")
    short = chunks.where("NOT segmented").select(
        "record_id", "type", "refers_to", F.col("n").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
    )
    found = short.unionByName(digest_chunks(chunks.where("segmented")))
    responses = found.where("type = 'response'")
    first = responses.select(
        F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest"
    )
    revisits = found.where("type = 'revisit'").select("record_id", "type", "refers_to")
    return responses.unionByName(revisits.join(first, "refers_to").select(*responses.columns))


def archived(pages: DataFrame, path: str, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Write ``pages`` to ``path`` and read them back: one row for each input row.

    A null or empty html is an empty payload; a null url leaves its header out; payloads over
    ``chunk`` bytes are segmented; equal payloads of at least ``least`` bytes share one response,
    that of the largest page id (null ids are smallest); repeated rows share a record, and all
    rows of the response's page id with that payload are responses; an empty table gives no rows;
    further columns are ignored.
    """
    pages = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    write_archives(pages, path, least, chunk)
    back = read_archives(pages.sparkSession, path)
    rows = pages.select(*row_key("page_id", "html"))
    rows = rows.select(F.nullif("_k", F.lit(NO_ID)).alias("page_id"), record_id("_k", "_h").alias("record_id"))
    refers = F.nullif(F.split("refers_to", ":")[2].cast("long"), F.lit(NO_ID))
    return rows.join(back, "record_id").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        refers.alias("refers_to"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN
      max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS best
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM r
"""
