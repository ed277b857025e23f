"""Line dedup: lines that many documents share stay in one of them.

Normalised lines are hashed where they stand; documents are counted per hash, each once, and the
positions to drop go back to their documents, which are put together again by position. Only
hashes and positions are shuffled per line; texts move once, whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import staged

BLANKS = " \t\n\x0b\x0c\r"
LEAST_DOCS, LEAST_CHARS = 2, 10


def _key(line: Column) -> Column:
    stripped = F.btrim(line, F.lit(BLANKS))
    return F.translate(stripped, string.ascii_uppercase, string.ascii_lowercase)


def _without(text: Column, gone: Column) -> Column:
    """The lines of the text but those at the sorted positions, in time linear in both: the
    positions become a string of one byte per line, and each line looks up its own. Both are
    bound once, as a variable."""
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, F.lit(1), F.size(gone) - 1))
    gaps = F.zip_with(before, gone, lambda a, b: F.repeat(F.lit("0"), b - a - 1))
    marks = F.concat(F.array_join(gaps, "1"), F.lit("1")).cast("binary")
    both = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), marks.alias("marks")))

    def joined(x: Column) -> Column:
        dropped = lambda line, i: F.substring(x["marks"], i + 1, F.lit(1)) != F.lit(b"1")
        return F.array_join(F.filter(x["lines"], dropped), "\n")

    return F.transform(both, joined)[0]


def drop_repeated(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``n_lines``, ``n_dropped`` (long) and ``kept`` (string) after them.

    Lines part at \\n; a null or empty text is one empty line. A line's key is the line stripped of
    blanks, with A-Z lower-cased. Keys of ``least_chars`` code points or more that stand in
    ``least_docs`` documents or more lose all their lines except in the document with the smallest
    id. Rows with one id are one document: lines they share stay in all of them. Rows without an id
    count as one document behind all ids. Equal up to collisions of 128-bit hashes. An empty table
    gives no rows; columns of the input named like the three new ones are replaced.
    """
    rows = docs.drop("n_lines", "n_dropped", "kept")
    body = F.coalesce(F.col(text), F.lit(""))
    # the text's hash is taken below the generator: above it, every line would carry the text
    listed = rows.select(F.col(key).alias("id"), F.xxhash64(text).alias("version"), body.alias("body")).select(
        "id", "version", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"),
    ).select("id", "version", "pos", _key(F.col("line")).alias("line")).where(
        F.length("line") >= least_chars
    ).select("id", "version", "pos", F.xxhash64("line").alias("h1"),
             F.xxhash64(F.lit(1), "line").alias("h2"))
    listed = staged(listed, "lines")

    shared = (
        listed.select("h1", "h2", "id").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("found"), F.min("id").alias("first"))
        .where(F.col("found") >= least_docs).drop("found")
    )
    gone = (
        listed.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first")))
        .groupBy("id", "version").agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
        .select(F.col("id").alias("_id"), F.col("version").alias("_version"), "_gone")
    )
    same = rows[key].eqNullSafe(gone["_id"]) & (F.xxhash64(rows[text]) == gone["_version"])
    at = gone["_gone"]
    return rows.join(gone, same, "left").select(
        *(rows[c] for c in rows.columns),
        F.size(F.split(body, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(at.isNull(), body).otherwise(_without(body, at)).alias("kept"),
    )


def dedup_sql(least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> str:
    """The same over ``documents`` in DuckDB, for tables whose ids are unique."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    WITH listed AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents
    ), keyed AS (
      SELECT *, translate(trim(line, {blanks}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS k
      FROM listed
    ), shared AS (
      SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= {least_chars}
      GROUP BY k HAVING count(DISTINCT doc_id) >= {least_docs}
    ), judged AS (
      SELECT keyed.*, coalesce(keyed.doc_id <> shared.first, false) AS gone
      FROM keyed LEFT JOIN shared USING (k)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """
