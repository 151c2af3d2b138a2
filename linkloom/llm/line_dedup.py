"""Line dedup: a line that several documents hold stays only in the first of them.

DataFrame functions only. Lines are normalised and hashed to 128 bits, distinct documents are counted per hash, and
the positions of the lines that go are joined back to their documents, so that line texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.tables import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
LAST_ID = 2**63 - 1


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with text_col less the repeated lines, and with n_lines (before) and n_dropped.

    A line's key is the line without white space [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased. Keys of at
    least min_chars code points that at least min_docs distinct ids hold lose all their lines, except in the smallest
    id holding them (there, all of them stay). id_col is an integer column.

    Defined cases: a null or empty text is one empty line and comes back as it was; a null id counts as one document
    that comes after all others; rows that repeat, with the same id and text, get the same result; rows with the same
    id and other texts count as one document; a text that loses all lines becomes empty; an empty table gives an empty
    table. Other columns pass through, whatever their names; n_lines and n_dropped replace columns of those names.
    """
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    own = own.withColumn("text_hash", F.xxhash64("body"))

    keys = F.transform(F.split(F.translate("body", UPPER, LOWER), "\n"), lambda line: F.btrim(line, F.lit(SPACES)))
    lines = settle(
        own.select("id", "text_hash", F.posexplode(keys).alias("pos", "key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    if min_docs == 2:  # two ids hold the key: the smallest is not the largest
        repeated = lines.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id").drop("last_id")
    else:
        repeated = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("one").alias("n")).where(F.col("n") >= min_docs).drop("n")
    # written out, so that the join below has a shuffle of its own on both sides, and a very common line is split there
    repeated = settle(repeated)
    gone = lines.join(repeated, ["h1", "h2"]).where("id > first_id").groupBy("id", "text_hash").agg(F.collect_set("pos").alias("gone"))

    parts = F.split("body", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")), lambda p: F.get(parts, p))
    out = own.join(gone, ["id", "text_hash"], "left").select(
        "row", F.size(parts).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )
    return out.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in others), "n_lines", "n_dropped")


def op9_line_dedup(spark, sf_dir):
    from linkloom.llm.tables import table

    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, r.first_id IS NOT NULL AND k.doc_id <> r.first_id AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
