"""Removal of globally repeated passages of two or more lines.

``line_dedup`` finds every repeated run of lines.  ``chunk_dedup`` judges whole chunks with
content-defined boundaries only, which is what ``OP4_SQL`` states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrogrid.llm.common import row_key, table
from pyrogrid.session import materialise

LINE_BITS = 1 << 31


def computed(docs: DataFrame, name: str, value: F.Column) -> DataFrame:
    """``docs`` with a column that is computed once per row.

    A projection would be merged into the lambdas that use it and be computed again for each
    element; a generated column is not.
    """
    return docs.withColumn(name, F.explode(F.array(value)))


def chunked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lines`` and ``codes``: first and last line number of each chunk in one long.

    A chunk ends where the rolling hash over the last two line hashes begins with a hex digit from
    0 to 3, on average every fourth line, so an insertion moves the next boundary or two only.
    """
    docs = computed(docs, "lines", F.split(F.col("text"), "\n"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("hashes"))
    rolled = F.zip_with(before, "hashes", lambda a, b: F.md5(F.concat(a, b)) < F.lit("4"))
    ends = F.array_compact(F.transform(rolled, lambda x, i: F.when(x, i + 1)))
    docs = computed(docs, "hashes", F.transform("lines", lambda x: F.md5(x)))
    docs = computed(docs, "ends", F.array_union(ends, F.array(F.size("lines"))))

    def code(end, j):
        start = F.when(j == 0, F.lit(1)).otherwise(F.element_at("ends", F.greatest(j, F.lit(1))) + 1)
        return start.cast("long") * LINE_BITS + end

    codes = F.when(F.col("lines").isNotNull(), F.transform("ends", code))
    return computed(docs, "codes", codes).drop("hashes", "ends")


def first_line(code: F.Column) -> F.Column:
    return F.floor(code / F.lit(LINE_BITS)).cast("int")


def line_count(code: F.Column) -> F.Column:
    return (code % LINE_BITS).cast("int") - first_line(code) + 1


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``_k, _h, removed``: the chunks of each document that an earlier document, or place, holds.

    Occurrences are counted by fingerprint first; only repeated chunks are then compared byte by
    byte with the first occurrence, which stays.
    """
    own = docs.select("text", *row_key("doc_id", "text"))
    rows = chunked(own).withColumn("code", F.explode("codes")).where(line_count(F.col("code")) > 1)
    body = F.array_join(F.slice("lines", first_line(F.col("code")), line_count(F.col("code"))), "\n")
    rows = rows.select("_k", "_h", "code", body.alias("body")).withColumn("mark", F.md5("body"))
    place = F.struct("_k", "_h", "code")
    first = (
        rows.groupBy("mark")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    again = materialise(rows.join(first.select("mark", "first"), "mark"), "chunks")
    kept = again.where(place == F.col("first")).select("mark", F.col("body").alias("kept_body"))
    return (
        again.where(place != F.col("first"))
        .join(kept, "mark")
        .where("body = kept_body")
        .groupBy("_k", "_h")
        .agg(F.collect_set("code").alias("removed"))
    )


def chunk_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that is left, and ``n_lines``, ``n_removed``, ``n_spans``.

    Of each chunk of two or more lines that occurs more than once anywhere, the occurrence with
    the smallest id and line stays; single lines are never removed.  A null text stays null with 0
    lines; an empty text is one empty line; a text without newlines is never changed; repeated
    rows are one document and get one result each; null ids sort first; an empty table gives no
    rows; columns named like the three counts are replaced.  A repeated passage that holds no
    whole chunk of two lines stays; ``line_dedup`` finds it.
    """
    docs = docs.drop("n_lines", "n_removed", "n_spans")
    removed = repeated_chunks(docs)
    hidden = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}  # names of the input may clash
    row = docs.select(
        *[F.col(f"`{c}`").alias(x) for c, x in hidden.items()], "text", *row_key("doc_id", "text")
    )
    joined = chunked(row.join(removed, ["_k", "_h"], "left"))
    kept = F.array_except("codes", "removed")
    joined = computed(joined, "kept", kept)
    body = F.flatten(
        F.transform("kept", lambda c: F.slice("lines", first_line(c), line_count(c)))
    )
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, c: a + line_count(c))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(body, "\n"))
    columns = [
        text.alias(c) if c == "text" else F.col(x).alias(c) for c, x in hidden.items()
    ]
    return joined.select(
        *columns,
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_spans"),
    )


def line_pairs(docs: DataFrame) -> DataFrame:
    """``_k, _h, line, mark``: the fingerprint of each two consecutive lines, by the first."""
    docs = computed(docs, "lines", F.split(F.col("text"), "\n"))
    docs = computed(docs, "hashes", F.transform("lines", lambda x: F.md5(x)))
    n = F.size("hashes") - 1
    marks = F.zip_with(
        F.slice("hashes", F.lit(1), n), F.slice("hashes", F.lit(2), n),
        lambda a, b: F.unhex(F.md5(F.concat(a, b))),
    )
    docs = docs.where(F.size("lines") > 1)
    docs = docs.select("_k", "_h", F.posexplode(marks).alias("line", "mark"))
    return docs.withColumn("line", F.col("line") + 1)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``_k, _h, gone``: the numbers of the lines that lie in a repeated run of two or more.

    A run is repeated where each two consecutive lines of it are, so pairs of lines need no
    extension.  Pairs are counted by fingerprint first; only the texts of repeated ones are then
    fetched and compared byte by byte with the first occurrence, which stays.
    """
    own = docs.select("text", *row_key("doc_id", "text"))
    rows = line_pairs(own)
    place = F.struct("_k", "_h", "line")
    first = rows.groupBy("mark").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("mark", "first")
    again = materialise(rows.join(first, "mark").where(place != F.col("first")), "pairs")
    start = again.select("first.*", "mark", "first").distinct()
    asked = again.select(*start.columns).union(start)
    asked = asked.groupBy("_k", "_h").agg(F.collect_set(F.struct("line", "mark", "first")).alias("p"))
    texts = computed(own.join(asked, ["_k", "_h"]), "lines", F.split("text", "\n"))
    texts = texts.select("_k", "_h", "lines", F.explode("p").alias("p")).select(
        "_k", "_h", "p.*", F.array_join(F.slice("lines", F.col("p.line"), 2), "\n").alias("body")
    )
    texts = materialise(texts, "bodies")
    kept = texts.where(place == F.col("first")).groupBy("mark").agg(F.min("body").alias("kept_body"))
    # Where a pair overlaps its own first occurrence, only the line beyond it goes.
    inside = F.col("first") == F.struct("_k", "_h", F.col("line") - 1)
    both = F.when(inside, F.array(F.col("line") + 1)).otherwise(
        F.array(F.col("line"), F.col("line") + 1)
    )
    return (
        texts.where(place != F.col("first"))
        .join(kept, "mark")
        .where("body = kept_body")
        .select("_k", "_h", F.explode(both).alias("line"))
        .groupBy("_k", "_h")
        .agg(F.collect_set("line").alias("gone"))
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that is left, and ``n_lines``, ``n_removed``, ``n_spans``.

    Each run of two or more lines that also stands at an earlier place, of a smaller id or further
    up, is removed wherever it begins and ends; each line that goes is still held by the first
    place of that line.  Single lines are never removed on their own.  ``n_spans`` counts the
    stretches that were cut out.  A null text stays null with 0 lines; an empty text is one empty
    line; a text without newlines is never changed; repeated rows are one document and get one
    result each; null ids sort first; an empty table gives no rows; columns named like the three
    counts are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "n_spans")
    gone = repeated_lines(docs)
    hidden = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}  # names of the input may clash
    row = docs.select(
        *[F.col(f"`{c}`").alias(x) for c, x in hidden.items()], "text", *row_key("doc_id", "text")
    )
    joined = computed(row.join(gone, ["_k", "_h"], "left"), "lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(1), F.size("lines")), "gone")
    joined = computed(joined, "kept", F.when(F.col("gone").isNotNull(), kept))
    body = F.array_join(F.transform("kept", lambda i: F.get("lines", i - 1)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(body)
    spans = F.size(F.array_except("gone", F.transform("gone", lambda i: i + 1)))
    columns = [text.alias(c) if c == "text" else F.col(x).alias(c) for c, x in hidden.items()]
    none = F.col("gone").isNull()
    return joined.select(
        *columns,
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(none, 0).otherwise(spans).cast("long").alias("n_spans"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chunks, as ``OP4_SQL`` has them; the pipeline takes ``line_dedup``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_dedup(docs).select(
        "doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256")
    )


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
  FROM documents),
marked AS (
  SELECT *, md5(lag(md5(line)) OVER w || md5(line)) < '4' AS ends FROM lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (
           PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM marked),
chunks AS (
  SELECT doc_id, c, min(i) AS s, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body
  FROM numbered GROUP BY doc_id, c),
judged AS (
  SELECT *, n > 1 AND row_number() OVER (PARTITION BY body, n > 1 ORDER BY doc_id, s) > 1 AS gone
  FROM chunks),
kept AS (
  SELECT doc_id, sum(n) AS n_lines, sum(CASE WHEN gone THEN n ELSE 0 END) AS n_removed,
         sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_spans,
         coalesce(string_agg(body, chr(10) ORDER BY s) FILTER (WHERE NOT gone), '') AS body
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines,
       coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN d.text IS NOT NULL THEN sha256(body) END AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
