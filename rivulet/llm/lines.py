"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines of a text make a window, hashed to 128 bits. A window whose three
lines also start earlier (in a smaller doc_id, or earlier in the same document) is a later
occurrence; the lines that later occurrences cover are removed, each once however many windows
cover it. Windows are judged on the input, not on what is left.

A first aggregation by hash keeps only the repeated windows with their first place (partial sums
make a window that a third of all documents hold as cheap as any), a join brings them back to
their places, and one more row per document carries the covered starts to the text.

Defined cases: a null text has no lines and stays null; a text of fewer than three lines has no
window and stays as it is; lines are what lies between ``\\n``, empty ones included; rows with the
same id and text are judged as one document, so repeated rows keep the same lines, while texts that share an id are
documents of their own, in the order of their hashes; an empty table gives an empty one; extra columns
pass through. Rows with a null id come before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, unused

NAME = "op10_line_dedup"
WINDOW = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def repeated_starts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, starts): the 0-based starts of windows that are later occurrences; ``mark`` is a hash of the text."""
    lines = df.where(F.col(text_col).contains("\n")).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), _lines(text_col).alias("lines"))
    three = [F.col("lines")[F.col("at") + k] for k in range(WINDOW)]
    windows = (
        lines.where(F.size("lines") >= WINDOW)
        .select("id", "mark", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - WINDOW)).alias("at"))
        .select("id", "mark", "at", F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit("second"), *three).alias("h2"))
    )
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "mark", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(first, ["h1", "h2"]).where("struct(id, mark, at) <> first")
    return later.groupBy("id", "mark").agg(F.collect_set("at").alias("starts"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with later occurrences removed from ``text_col``, and ``n_lines`` and ``n_removed``."""
    starts, key, mark = unused(df, "starts"), unused(df, "key"), unused(df, "mark")
    found = repeated_starts(df, id_col, text_col).select(F.col("id").alias(key), F.col("mark").alias(mark), F.col("starts").alias(starts))
    lines = _lines(text_col)
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + WINDOW - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    kept = F.transform(left, lambda i: lines[i])
    gone = F.coalesce(F.size(covered), F.lit(0))
    joined = df.join(found, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(mark)), "left")
    return joined.select(
        *(c for c in df.columns if c not in (text_col, "n_lines", "n_removed")),
        F.when(F.col(starts).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(text_col),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col(starts).isNull(), 0).otherwise(gone).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
triples AS (
  SELECT doc_id, pos, line,
         lead(line, 1) OVER d AS second, lead(line, 2) OVER d AS third
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos,
         row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, pos) AS k
  FROM triples WHERE third IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, pos + step AS pos
  FROM ranked, (SELECT unnest([0, 1, 2]) AS step) WHERE k > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS rest
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
  GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       sha256(k.rest) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
