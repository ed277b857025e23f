"""Licence scans: passages against licence templates by Dice coefficient over word bigrams.

Passages are the lines of a text and, if it has several, the whole text. Words are runs of ASCII
letters and digits in lower case. Bigrams count as often as they occur. A template can reach the
least coefficient only with passages of similar size, so sizes select the templates to compare.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm.common import utf8

LEAST = 0.8

# Wordings of licence notices (name, text). A name may come with several texts.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights "
                "to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_WORDS = re.compile(rb"[a-z0-9]+")
_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(passage: bytes) -> list[bytes]:
    return _WORDS.findall(passage.translate(_ASCII_LOWER))


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


def compiled(templates=TEMPLATES) -> list[tuple[str, int, Counter]]:
    """(name, size, bigrams) by name and size; templates under two words are left out."""
    out = [(name, len(w) - 1, bigrams(w)) for name, text in templates if len(w := words_of(text.encode())) > 1]
    return sorted(out, key=lambda t: (t[0], t[1]))


def best(words: list[bytes], templates, least: float) -> tuple[str, float] | None:
    """Name and coefficient of the template closest to a passage; the first by name in a tie."""
    size, found, held = len(words) - 1, None, None
    for name, n, grams in templates:
        if 2 * min(n, size) < least * (n + size):
            continue
        held = held or bigrams(words)
        common = sum(min(c, held[g]) for g, c in grams.items() if g in held)
        dice = 2.0 * common / (n + size)
        if dice >= least and (found is None or dice > found[1]):
            found = (name, dice)
    return found


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Rows (doc_id, passage, licence, score), one per passage that matches a template.

    ``passage`` is the number of the line, from 1, or 0 for the whole text of several lines.
    Null, empty and blank texts match nothing; repeated rows and lines match each time; other
    columns are not read. ``key`` is a long and may be null.
    """
    held = docs.sparkSession.sparkContext.broadcast(compiled(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [n for _, n, _ in held.value]
        most = max(sizes, default=0) * (2 - least) / least if least else float("inf")
        fewest = min(sizes, default=0) * least / (2 - least)
        # a word takes a byte at least, and so does what parts words
        shortest = 2 * fewest - 1
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, body in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                lines = body.split(b"\n")
                for at, line in enumerate([body, *lines] if len(lines) > 1 else [b"", *lines]):
                    if len(line) < shortest:
                        continue
                    words = words_of(line)
                    if not fewest <= len(words) - 1 <= most:
                        continue
                    if hit := best(words, held.value, least):
                        for column, value in zip(out, (doc, at, *hit)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                 pa.array(out[3], pa.float64())], ["doc_id", "passage", "licence", "score"])

    return docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text").mapInArrow(
        run, "doc_id long, passage long, licence string, score double")


def scan_sql(templates=TEMPLATES, least: float = LEAST) -> str:
    """The same over ``documents`` as DuckDB SQL: repeated bigrams are told apart by a number."""
    rows = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(templates))
    words = "list_filter(regexp_split_to_array(lower(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
    numbered = """
      SELECT {0}, a, row_number() OVER (PARTITION BY {0}, a) AS o, n FROM (
        SELECT {0}, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a
        FROM {1} WHERE len(w) > 1)"""
    return f"""
    WITH t AS (SELECT id, name, {words.format('body')} AS w FROM (VALUES {rows}) v(id, name, body)),
    l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents WHERE text IS NOT NULL),
    p AS (
      SELECT doc_id, passage, {words.format('body')} AS w FROM (
        SELECT doc_id, unnest(range(1, len(ls) + 1)) AS passage, unnest(ls) AS body FROM l
        UNION ALL SELECT doc_id, 0, text FROM l WHERE len(ls) > 1)),
    p2 AS (SELECT doc_id * 1000000 + passage AS pid, w FROM p WHERE len(w) BETWEEN 2 AND (
      SELECT 2 + max(len(w)) * (2 - {least}) / {least} FROM t)),
    tg AS ({numbered.format('id', 't')}),
    pg AS ({numbered.format('pid', 'p2')}),
    m AS (
      SELECT pid, id, 2.0::DOUBLE * count(*) / (any_value(pg.n) + any_value(tg.n)) AS score
      FROM pg JOIN tg USING (a, o) GROUP BY pid, id)
    SELECT pid // 1000000 AS doc_id, pid % 1000000 AS passage, arg_min(name, (-score, name)) AS licence,
      max(score) AS score
    FROM m JOIN t USING (id) WHERE score >= {least} GROUP BY pid"""
