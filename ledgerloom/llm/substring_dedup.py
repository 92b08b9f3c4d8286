"""Substring dedup: repeated units of text (pieces of sentences, lines or paragraphs) are found by global hashing and removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, hash_words, mix, stage, text_batches, texts_to_python

#: A unit has so many words at least; shorter pieces are joined with their neighbours.
MIN_WORDS = 8
#: Repeated units go where they make up a passage of so many words; fewer repeat by chance and are left alone.
PASSAGE = 15
#: A sentence is cut before a word whose MD5 is the least among REACH words on either side, all in the sentence.
REACH = 6
#: What ends a unit besides the end of the text: line ends or empty lines between words, and marks at the end of a word.
UNITS = {"sentence": (2, b".!?"), "line": (1, b""), "paragraph": (2, b"")}

UNIT_ROWS = "doc_id long, tag long, word int, start int, end int, n_words int, digest binary"


def cuts(keys: np.ndarray, place: np.ndarray, size: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The words (of sentences of `size` words, at `place` in them) before which a sentence is cut.

    Only `reach` words on either side of a cut decide on it, so a passage is cut alike wherever it stands, without
    any punctuation, but for as many words at its ends.
    """
    at = np.flatnonzero((place >= reach) & (place < size - reach))
    for j in range(1, reach + 1):
        at = at[(keys[at] < keys[at - j]) & (keys[at] <= keys[at + j])]
    return at


def sums(h: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of hashes times powers of 1 / step, and the powers of step, modulo 2^64."""
    n = len(h)
    up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (step, pow(step, -1, 1 << 64)))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down[:-1])]), up


def units_of(texts: list[str | None], unit: str, min_words: int) -> tuple[np.ndarray, ...]:
    """Units of several texts: text, first word, start and end (code points), number of words, two 64-bit hashes.

    A piece is a line, a paragraph (what stands between empty lines) or, as "sentence", what ends in . ! or ? within
    one, cut by content where it is long.  A unit is the shortest run of pieces with `min_words` words that begins, or
    that ends, with a piece (a piece with so many words is one by itself), so every repeated run of pieces with so
    many words is covered by repeated units, which may overlap.
    """
    lines, marks = UNITS[unit]
    texts = [t or "" for t in texts]
    low = [t.lower() for t in texts]
    h, low_start, low_end, ends = hash_words(low)
    _, start, end, _ = hash_words(texts)  # lower case moves words, but makes and joins none
    raw = " ".join([*texts, ""]).encode("utf-8", "replace")
    byte = np.frombuffer(raw, np.uint8)
    n, text = len(h), np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    begin, stop = np.concatenate([[0], ends]).astype(np.int64)[text], ends[text]
    breaks = np.concatenate([[0], np.cumsum(byte == 10)])
    first = np.concatenate([[True], (text[1:] != text[:-1]) | (breaks[start[1:]] - breaks[end[:-1]] >= lines)])[:n]
    if marks:
        first[1:] |= np.isin(byte[end[:-1] - 1], list(marks))
        sentence = np.flatnonzero(first)
        size = np.diff(np.append(sentence, n))
        place, size = np.arange(n) - np.repeat(sentence, size), np.repeat(size, size)
        long = np.flatnonzero(size > 2 * REACH)
        if len(long):
            _, at, same = np.unique(h[long], return_index=True, return_inverse=True)
            spelled = " ".join([*low, ""]).encode("utf-8", "replace")
            md5 = [hashlib.md5(spelled[a:b]).digest()[:8] for a, b in zip(low_start[long[at]].tolist(), low_end[long[at]].tolist())]
            keys = np.zeros(n, np.uint64)
            keys[long] = np.frombuffer(b"".join(md5), ">u8").astype(np.uint64)[same]
            first[cuts(keys, place, size)] = True
    piece = np.flatnonzero(first)
    over = np.append(piece[1:], n)[: len(piece)]  # where each piece ends
    of = np.cumsum(first) - 1
    on, back = piece + min_words - 1, over - min_words
    fits, held = on < stop[piece], back >= begin[piece]
    pairs = np.stack([np.concatenate([piece[fits], piece[of[back[held]]]]), np.concatenate([over[of[on[fits]]], over[held]])], 1)
    a, b = np.unique(pairs, axis=0).T if len(pairs) else pairs.T
    (s1, up1), (s2, up2) = sums(h, 0xD6E8FEB86659FD93), sums(h, 0xA0761D6478BD642F)
    points = np.concatenate([[0], np.cumsum((byte & 0xC0) != 0x80)])
    base = points[np.cumsum([0, *(len(t.encode("utf-8", "replace")) + 1 for t in texts)])]
    return text[a], a - begin[a], points[start[a]] - base[text[a]], points[end[b - 1]] - base[text[a]], b - a, mix((s1[b] - s1[a]) * up1[a]), mix((s2[b] - s2[a]) * up2[a])


def units(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each unit (see `units_of`), with its first word, its code point offsets and its 128-bit digest.

    `tag` is a hash of the row's text: it tells rows apart that have one doc_id, or none, but different texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in text_batches(batches):
            text, word, start, end, n, x, y = units_of(b["text"].tolist(), unit, min_words)
            raw = np.stack([x, y], 1).tobytes()
            ids, tags = b["doc_id"].astype("Int64").array, b["tag"].to_numpy()
            yield pd.DataFrame({"doc_id": ids[text], "tag": tags[text], "word": word, "start": start, "end": end, "n_words": n, "digest": [raw[k : k + 16] for k in range(0, len(raw), 16)]})

    picked = texts_to_python(docs).select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col].cast("string")).alias("tag"), docs[text_col].cast("string").alias("text"))
    return picked.mapInPandas(run, UNIT_ROWS)


def repeated_units(
    docs: DataFrame,
    unit: str = "sentence",
    min_words: int = MIN_WORDS,
    passage: int = PASSAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each unit to remove: doc_id, tag, start, end, n_words, keeper_doc_id, keeper_start.

    Units are normalised (lower case, single spaces) and hashed to 128 bits; digests are grouped over all documents,
    and the occurrence that ranks first by (doc_id, tag, start) is kept.  Every other one is repeated; repeated units
    of a text that overlap or touch make up a passage, and those of passages with at least `passage` words are the
    rows here, with their original offsets (code points, end exclusive).

    Null ids rank last.  A null or empty text has no units.  Rows that repeat a doc_id (or have none) with the same
    text are one occurrence, so both keep their units; with other texts they are different occurrences, ranked by a
    hash of the text (tag).  An empty table gives an empty result; other columns are not read.  Digests are counted
    before they are shuffled, and those that hold a large share of all units are joined by broadcast, so no task
    gathers all copies of a unit.
    """
    held = stage(units(docs, unit, min_words, id_col, text_col), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("keeper_doc_id"), F.col("tag").alias("keeper_tag"), F.col("start").alias("keeper_start"))
    first = held.groupBy("digest").agg(F.min(rank).alias("keeper"), F.count("*").alias("copies")).filter("copies > 1")
    first = stage(first, "repeated")
    later = attach(held, first, "digest", "copies").filter(rank > F.col("keeper"))
    later = later.select("doc_id", "tag", "word", "start", "end", "n_words", "keeper.keeper_doc_id", "keeper.keeper_start").distinct()
    text = Window.partitionBy("doc_id", "tag").orderBy("word", "end")
    reach = F.max(F.col("word") + F.col("n_words")).over(text.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("_passage", F.sum(F.when(F.col("word") <= reach, 0).otherwise(1)).over(text))
    whole = Window.partitionBy("doc_id", "tag", "_passage")
    words = F.max(F.col("word") + F.col("n_words")).over(whole) - F.min("word").over(whole)
    return later.withColumn("_words", words).filter(F.col("_words") >= passage).drop("_words", "_passage", "word")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the code points in `spans` (doc_id, tag, start, end, as `repeated_units` returns them).

    All columns stay, and so do texts without spans and null ones; rows that repeat a doc_id (or have none) and its
    text lose the same spans.  A text may become empty.
    """
    by_doc = spans.groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut"))

    @F.pandas_udf("string")
    def without(text: pd.Series, cut: pd.Series) -> pd.Series:
        out = []
        for t, c in zip(text, cut):
            if t is not None and c is not None and len(c):
                parts, at = [], 0
                for s in c:
                    parts.append(t[at : max(at, s["start"])])
                    at = max(at, s["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    docs = texts_to_python(docs)
    joined = docs.join(by_doc, docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_tag")), "left")
    return joined.select(*(docs[c] if c != text_col else without(docs[text_col], "_cut").alias(text_col) for c in docs.columns))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_units(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "n_words")), "keeper_doc_id", F.col("keeper_start").cast("long").alias("keeper_start"))


#: The same units, ranks and passages in DuckDB; ids are unique there, so the tag plays no part.
OP1_SQL = rf"""
WITH bits AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+')) AS bit,
         generate_subscripts(regexp_extract_all(text, '[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+'), 1) AS i
  FROM documents
), placed AS (
  SELECT *, sum(length(bit)) OVER (PARTITION BY doc_id ORDER BY i) AS b, lag(bit) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM bits
), words AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS word, b - length(bit) AS a, b, lower(bit) AS w, md5(lower(bit)) AS key,
         len(coalesce(gap, '')) - len(replace(coalesce(gap, ''), chr(10), '')) >= 2 AS apart, regexp_matches(bit, '[.!?]$') AS ends
  FROM placed WHERE regexp_matches(bit, '[^ \t\n\r\f\v]')
), opened AS (
  SELECT *, word = 0 OR apart OR lag(ends) OVER (PARTITION BY doc_id ORDER BY word) AS first FROM words
), sentences AS (
  SELECT *, sum(first::INTEGER) OVER (PARTITION BY doc_id ORDER BY word) AS sentence FROM opened
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY word) - 1 AS place, count(*) OVER (PARTITION BY doc_id, sentence) AS size FROM sentences
), marked AS (
  SELECT *, first OR (place >= {REACH} AND place < size - {REACH}
      AND key < min(key) OVER (PARTITION BY doc_id, sentence ORDER BY word ROWS BETWEEN {REACH} PRECEDING AND 1 PRECEDING)
      AND key <= min(key) OVER (PARTITION BY doc_id, sentence ORDER BY word ROWS BETWEEN 1 FOLLOWING AND {REACH} FOLLOWING)) AS begins
  FROM sized
), parts AS (
  SELECT *, sum(begins::INTEGER) OVER (PARTITION BY doc_id ORDER BY word) AS piece FROM marked
), pieces AS (
  SELECT doc_id, piece, min(word) AS lo, max(word) + 1 AS hi FROM parts GROUP BY 1, 2
), reach AS (
  SELECT x.doc_id, x.lo, min(y.hi) AS hi FROM pieces x JOIN pieces y ON x.doc_id = y.doc_id AND y.hi >= x.lo + {MIN_WORDS} AND y.piece >= x.piece GROUP BY 1, 2
  UNION
  SELECT y.doc_id, max(x.lo) AS lo, y.hi FROM pieces y JOIN pieces x ON x.doc_id = y.doc_id AND x.lo <= y.hi - {MIN_WORDS} AND x.piece <= y.piece GROUP BY y.doc_id, y.hi
), texts AS (
  SELECT doc_id, list(w ORDER BY word) AS ws, list(a ORDER BY word) AS a_s, list(b ORDER BY word) AS b_s FROM words GROUP BY 1
), unit AS (
  SELECT doc_id, lo, hi, a_s[lo + 1] AS start, b_s[hi] AS "end", array_to_string(ws[lo + 1 : hi], ' ') AS body FROM reach JOIN texts USING (doc_id)
), ranked AS (
  SELECT *, first_value(doc_id) OVER v AS keeper_doc_id, first_value(start) OVER v AS keeper_start FROM unit WINDOW v AS (PARTITION BY body ORDER BY doc_id, start)
), later AS (
  SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
  FROM ranked WHERE (doc_id, start) <> (keeper_doc_id, keeper_start)
), grouped AS (
  SELECT *, sum(CASE WHEN lo <= reached THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY lo, "end" ROWS UNBOUNDED PRECEDING) AS passage FROM later
), measured AS (
  SELECT *, max(hi) OVER (PARTITION BY doc_id, passage) - min(lo) OVER (PARTITION BY doc_id, passage) AS n_passage FROM grouped
)
SELECT doc_id, start::BIGINT AS start, "end"::BIGINT AS "end", (hi - lo)::BIGINT AS n_words, keeper_doc_id, keeper_start::BIGINT AS keeper_start
FROM measured WHERE n_passage >= {PASSAGE}
"""
