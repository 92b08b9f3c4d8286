"""Line dedup by winnowing: window minima of line hashes are fingerprints that find repeated runs of lines.

Windows hold a number of lines, or (window=None) as many as hold enough words; then every run that holds them is found.
Positions of repeated fingerprints are joined by the windows around them, and matches on one diagonal of two texts
are extended both ways to the longest run that they have in common.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, stage, text_batches, texts_to_python

#: Lines in a winnowing window: every repeated run of so many lines shares a fingerprint.
WINDOW = 2
#: A window with fewer words repeats by chance and is left alone.
MIN_WORDS = 10

PRINTS = "doc_id long, tag long, print binary, run binary, first int, size int, lead boolean"


def line_hashes(text: str | None) -> tuple[list[int], list[bytes], list[int]]:
    """Line numbers, 128-bit hashes of the stripped lines, and word counts of the lines that hold a word."""
    numbers, hashes, words = [], [], []
    for k, line in enumerate((text or "").split("\n")):
        raw = line.encode("utf-8", "replace").strip()
        if raw:
            numbers.append(k)
            hashes.append(xxhash.xxh3_128_digest(raw))
            words.append(len(raw.split()))
    return numbers, hashes, words


def reach(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """The windows (first, end) that cover every run of `min_words` words or more: the shortest from each line, and up to each line.

    A line of a run is in the window that begins with it, unless that leaves the run; then too few words follow
    it there, and the window that ends with the run holds it.
    """
    total, out = [0, *itertools.accumulate(words)], set()
    for k in range(len(words)):
        if (end := bisect.bisect_left(total, total[k] + min_words)) < len(total):
            out.add((k, max(end, k + 1)))
        if (first := bisect.bisect_right(total, total[k + 1] - min_words) - 1) >= 0:
            out.add((min(first, k), k + 1))
    return sorted(out)


def spans(words: list[int], window: int | None, min_words: int) -> list[tuple[int, int]]:
    """(first, end) of the windows of lines with these word counts."""
    if window is None:
        return reach(words, min_words)
    return [(a, a + window) for a in range(len(words) - window + 1) if sum(words[a : a + window]) >= min_words]


def winnow(hashes: list[bytes], windows: list[tuple[int, int]]) -> list[int]:
    """For each window (first, end), the position of its least hash (the rightmost of equals)."""
    return [min(range(a, b), key=lambda k: (hashes[k], -k)) for a, b in windows]


def fingerprints(docs: DataFrame, window: int | None, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each window of each document: the fingerprint that it selects, its own hash, first line and lines.

    `lead` marks one window of each fingerprint position, so that positions can be counted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in text_batches(batches):
            out = []
            for d, tag, t in zip(b["doc_id"].tolist(), b["tag"].tolist(), b["text"]):
                _, hashes, words = line_hashes(t)
                held, seen = spans(words, window, min_words), set()
                for (first, end), at in zip(held, winnow(hashes, held)):
                    out.append((d, tag, hashes[at], xxhash.xxh3_128_digest(b"".join(hashes[first:end])), first, end - first, at not in seen))
                    seen.add(at)
            yield pd.DataFrame(out, columns=["doc_id", "tag", "print", "run", "first", "size", "lead"])

    known = texts_to_python(docs).filter(docs[id_col].isNotNull())
    return known.select(known[id_col].cast("long").alias("doc_id"), tag_of(known[text_col]), known[text_col].cast("string").alias("text")).mapInPandas(run, PRINTS)


def tag_of(text):
    """What tells texts of one doc_id apart."""
    return F.xxhash64(text.cast("string")).alias("tag")


def matches(docs: DataFrame, window: int | None = WINDOW, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The repeated runs: doc_id, tag, first, n_lines, source_doc_id, source_tag, source_first, one row for each extended match.

    Fingerprints (minima of the hashes in each window) are counted over all documents first; only those at two
    places or more bring the windows around them into the second shuffle, where each window meets the earliest
    equal one.  Matches with one source that stand on one diagonal (the same distance between the two places) and
    overlap or touch are one longer run: each is extended by its neighbours, both ways, as far as lines agree.
    """
    prints = stage(fingerprints(docs, window, min_words, id_col, text_col), "prints")
    twice = prints.groupBy("print").agg(F.count_if("lead").alias("places"), F.count("*").alias("n")).filter("places > 1").drop("places")
    runs = stage(attach(prints, stage(twice, "twice"), "print", "n").select("doc_id", "tag", "run", "first", "size"), "runs")
    place = F.struct("doc_id", "tag", "first")
    earliest = runs.groupBy("run").agg(F.min(place).alias("source"), F.count("*").alias("n")).filter("n > 1")
    later = attach(runs, stage(earliest, "earliest"), "run", "n").filter(place > F.col("source")).select("doc_id", "tag", "first", "size", "source").distinct()
    later = later.withColumn("shift", F.col("first") - F.col("source.first")).withColumn("end", F.col("first") + F.col("size"))
    line = Window.partitionBy("doc_id", "tag", "source.doc_id", "source.tag", "shift").orderBy("first", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("island", F.sum(F.when(F.col("first") <= reach, 0).otherwise(1)).over(line))
    joined = later.groupBy("doc_id", "tag", F.col("source.doc_id").alias("source_doc_id"), F.col("source.tag").alias("source_tag"), "shift", "island")
    joined = joined.agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return joined.select("doc_id", "tag", "first", (F.col("end") - F.col("first")).alias("n_lines"), "source_doc_id", "source_tag", (F.col("first") - F.col("shift")).alias("source_first"))


def repeated_runs(docs: DataFrame, window: int | None = WINDOW, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text that loses lines: doc_id, tag, lines array<int> (sorted, among lines that hold a word).

    A line goes when it lies in a run of `window` or more lines (of `min_words` words a window) that occurs
    earlier by (doc_id, tag, line).  With window=None, it goes when it lies in a run of one or more lines, of `min_words`
    words in total, that occurs earlier: one long line between other neighbours, and many short lines.  The runs are
    those of `matches`.  The first occurrence of a line's text never goes.

    Null ids are left alone.  Null and empty texts have no lines.  Rows that repeat a doc_id with the same text
    are one occurrence; with other texts they are told apart by a hash of the text (tag).  An empty table gives an
    empty result; other columns are not read.
    """
    found = matches(docs, window, min_words, id_col, text_col)
    lines = found.select("doc_id", "tag", F.explode(F.sequence("first", F.col("first") + F.col("n_lines") - 1)).alias("line"))
    return lines.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, window: int | None = WINDOW, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without later repeated runs of lines; a document that keeps no word of those it had is left out.

    All columns stay.  Documents that lose nothing are unchanged to the byte, empty ones included.
    """
    cut = repeated_runs(docs, window, min_words, id_col, text_col).withColumnsRenamed({"doc_id": "_id", "tag": "_tag", "lines": "_lines"})

    @F.pandas_udf("string")
    def without(text: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for t, gone in zip(text, lines):
            if t is not None and gone is not None and len(gone):
                numbers, _, _ = line_hashes(t)
                drop = {numbers[k] for k in np.asarray(gone).tolist() if k < len(numbers)}
                t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
                t = t if t.strip() else None
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = docs.join(cut, (docs[id_col].cast("long") == F.col("_id")) & (tag_of(docs[text_col]) == F.col("_tag")), "left")
    joined = joined.withColumn("_new", without(docs[text_col], "_lines")).filter(F.col("_new").isNotNull() | F.col("_lines").isNull())
    return joined.select(*(F.col("_new").alias(c) if c == text_col else docs[c] for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=None)
    return out.select("doc_id", F.size("lines").alias("n_removed"), F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


#: Runs are the shortest ones of ten words from each line and up to each line; longer ones are made of these.
OP3_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
), kept AS (
  SELECT doc_id, k, regexp_replace(line, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g') AS line FROM split
), lines AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^ \t\r\f\v]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos
  FROM kept WHERE line <> ''
), summed AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM lines
), reach AS (
  SELECT a.doc_id, a.pos AS first, min(b.pos) AS last FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.total - a.total + a.w >= 10 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.pos) AS first, b.pos AS last FROM summed b JOIN summed a ON a.doc_id = b.doc_id AND a.pos <= b.pos AND b.total - a.total + a.w >= 10 GROUP BY b.doc_id, b.pos
), held AS (
  SELECT doc_id, list(line ORDER BY pos) AS all_lines FROM lines GROUP BY 1
), runs AS (
  SELECT doc_id, first, last, array_to_string(all_lines[first + 1 : last + 1], chr(10)) AS body FROM reach JOIN held USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS r FROM runs
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM ranked WHERE r > 1
)
SELECT doc_id, count(*)::INTEGER AS n_removed, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS lines FROM gone GROUP BY doc_id
"""
