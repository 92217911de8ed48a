"""Inputs derived from the star-schema tables, in Spark and, as common table expressions, in SQL.

``sheet``: events as a line stream of labels, chords, comments, blanks and lyrics by user.  ``boxes``:
line items as word boxes of order pages.  ``tokens``: chord tokens with misreadings by order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import at
from ..operators.sequence import explode_lines

CHORDS = ("C", "Am", "F", "G", "Bb", "B7", "H7", "Em", "Cmaj7", "D/F#", "Bm/B", "A/B")
MISREAD = ("Bim", "Blsus4", "Cma7", "Gi7", "Ah", "e", "E", "(G)", "F#m7", "hello", "Cis", "am", "X", "Gmai7", "Di9", "A/Bb")
LABELS = ("Vers 1", "Chorus:", "Bridge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(table(spark, sf_dir, "documents"))


LINES = "lines AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, line_no, line, is_chord, is_label, explicit)``."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 13
    line = (
        F.when(k.isin(0, 7, 12), "").when(k == 1, F.concat(F.lit("Vers "), (F.col("event_id") % 4 + 1).cast("string"))).when(k == 2, "Chorus:").when(k == 4, "Bridge")
        .when(k == 3, "C  G  Am").when(k == 8, "F  Em").when(k == 5, "{comment: Chorus}").when(k == 6, F.concat(F.lit("{comment: Vers "), (F.col("event_id") % 2 + 1).cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit("oh the "), "event_type", F.lit(" goes on and on "), F.col("user_id").cast("string")))
    )
    explicit = F.when(k == 1, F.concat(F.lit("verse "), (F.col("event_id") % 4 + 1).cast("string"))).when(k == 2, "chorus").when(k == 4, "bridge")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("doc_id"), n.alias("line_no"), line.alias("line"), k.isin(3, 8).alias("is_chord"), k.isin(1, 2, 4).alias("is_label"), explicit.alias("explicit"))


SHEET = """sheet AS (SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS line_no,
  CASE WHEN event_id % 13 IN (0, 7, 12) THEN '' WHEN event_id % 13 = 1 THEN 'Vers ' || (event_id % 4 + 1) WHEN event_id % 13 = 2 THEN 'Chorus:' WHEN event_id % 13 = 4 THEN 'Bridge'
    WHEN event_id % 13 = 3 THEN 'C  G  Am' WHEN event_id % 13 = 8 THEN 'F  Em' WHEN event_id % 13 = 5 THEN '{comment: Chorus}' WHEN event_id % 13 = 6 THEN '{comment: Vers ' || (event_id % 2 + 1) || '}'
    ELSE 'oh the ' || event_type || ' goes on and on ' || user_id END AS line,
  event_id % 13 IN (3, 8) AS is_chord, event_id % 13 IN (1, 2, 4) AS is_label,
  CASE WHEN event_id % 13 = 1 THEN 'verse ' || (event_id % 4 + 1) WHEN event_id % 13 = 2 THEN 'chorus' WHEN event_id % 13 = 4 THEN 'bridge' END AS explicit FROM events)"""


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _sql_pick(values: tuple[str, ...], index: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[CAST({index} % {len(values)} + 1 AS INTEGER)]"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, pos, token, chord)``: what recognition read, and a clean chord, by order line."""
    i = table(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"), _pick(MISREAD, F.col("l_partkey")).alias("token"), _pick(CHORDS, F.col("l_partkey") + F.col("l_suppkey")).alias("chord"))


TOKENS = f"tokens AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_partkey AS part, {_sql_pick(MISREAD, 'l_partkey')} AS token, {_sql_pick(CHORDS, '(l_partkey + l_suppkey)')} AS chord FROM lineitem)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, page_no, line_no, word_no, left, top, right, bottom, is_chord)``."""
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    left, top = (F.col("p") * 37 % 900).cast("double"), ((F.col("l_linenumber") * 53 + F.col("p") * 11 + F.col("l_orderkey")) % 700).cast("double")
    return i.select(
        F.expr("l_orderkey div 4").cast("long").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("l_orderkey") % 4 * 10 + F.col("l_linenumber")).cast("int").alias("line_no"), F.col("l_linenumber").alias("word_no"),
        left.alias("left"), top.alias("top"), (left + 40 + F.col("s") % 90).alias("right"), (top + 10 + F.col("p") % 25).alias("bottom"), (F.col("p") % 3 == 0).alias("is_chord"),
    )


BOXES = """boxes AS (SELECT CAST(l_orderkey // 4 AS BIGINT) AS doc_id, 1 AS page_no, CAST(l_orderkey % 4 * 10 + l_linenumber AS INTEGER) AS line_no, l_linenumber AS word_no,
  CAST(p * 37 % 900 AS DOUBLE) AS "left", CAST((l_linenumber * 53 + p * 11 + l_orderkey) % 700 AS DOUBLE) AS top, CAST(p * 37 % 900 AS DOUBLE) + 40 + s % 90 AS "right",
  CAST((l_linenumber * 53 + p * 11 + l_orderkey) % 700 AS DOUBLE) + 10 + p % 25 AS bottom, p % 3 = 0 AS is_chord
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL))"""


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, line)``: header and credit lines made from customers."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 6
    name = F.lower("c_name")
    line = F.when(k == 0, F.concat(F.lit("Title: "), name)).when(k == 1, F.concat(F.lit("Melodie: "), name, F.lit("; Satz: "), F.lower("c_mktsegment"))).when(k == 2, F.concat(F.lit("Text: "), name)).when(k == 3, F.concat(F.lit("© "), name)).when(k == 4, F.concat(F.lit("Note: "), name)).otherwise(F.concat(F.lit("Autor: "), name))
    return c.select(F.col("c_custkey").alias("doc_id"), line.alias("line"))


CREDITS = """credits AS (SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN 'Title: ' || lower(c_name) WHEN 1 THEN 'Melodie: ' || lower(c_name) || '; Satz: ' || lower(c_mktsegment) WHEN 2 THEN 'Text: ' || lower(c_name)
  WHEN 3 THEN '© ' || lower(c_name) WHEN 4 THEN 'Note: ' || lower(c_name) ELSE 'Autor: ' || lower(c_name) END AS line FROM customer)"""
