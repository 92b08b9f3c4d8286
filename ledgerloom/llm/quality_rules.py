"""Quality rules: how much of a text lies inside repeated word n-grams and repeated lines."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import covered, hash_words, per_text, repeated, text_batches, texts_to_python, windows

#: Largest share of a text's word characters that may lie inside repeated n-grams of each length.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines that repeat an earlier line.
LINE_LIMIT = 0.20
SYMBOLS = "#*$%&|<>"
BASE_WINDOW, BASE_MIN_WORDS, BASE_PERCENT = 8, 20, 30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, dup_line_share double, ngram_shares array<double>, kept boolean"
)


def characters(texts: list[str], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lengths in code points of words given by their places in the joined texts."""
    raw = np.frombuffer(" ".join([*texts, ""]).encode("utf-8", "replace"), np.uint8)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return before[end] - before[start]


def measure(text: str, h: np.ndarray, length: np.ndarray, limits: dict[int, float], line_limit: float) -> tuple:
    """The measures of one text, given the hashes of its words and their lengths in characters."""
    n, chars = len(h), int(length.sum())
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.encode("utf-8", "replace").strip()]
    seen = Counter(lines)
    dup_lines = len(lines) - len(seen)
    line_chars = sum(map(len, lines))
    dup_share = sum(len(k) * (v - 1) for k, v in seen.items() if v > 1) / line_chars if dup_lines else 0.0
    shares, repeat_words = [], 0
    for size in sorted({BASE_WINDOW, *limits}):
        inside = covered(repeated(windows(h, size)), size, n) if n > size else np.zeros(n, bool)
        if size == BASE_WINDOW:
            repeat_words = int(inside.sum())
        if size in limits:
            shares.append(float(length[inside].sum() / chars) if chars else 0.0)
    failed = n < BASE_MIN_WORDS or 100 * repeat_words > BASE_PERCENT * n
    kept = not failed and dup_share <= line_limit and all(s <= limits[k] for s, k in zip(shares, sorted(limits)))
    return n, chars, symbols, dup_lines, repeat_words, failed, dup_share, shares, kept


def repetition_coverage(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: dict[int, float] | None = None,
    line_limit: float = LINE_LIMIT,
) -> DataFrame:
    """One row for each row of `docs` with the repetition measures of its whole text and the verdict `kept`.

    Words are runs of characters other than ASCII white space.  For each n of `limits`, words are hashed once,
    windows of n words get a rolling polynomial hash in numpy, and the characters of the words inside windows
    that occur twice or more are counted as a share of all word characters; lines that repeat an earlier one
    are measured likewise.  A text is kept when the base rule passes and every share is within its limit.

    A null or empty text has no words, counts 0, fails the base rule and is not kept.  Repeated rows give
    repeated results; a null id stays null.  Other columns of `docs` are neither read nor returned, so their
    names can't clash.  An empty table gives an empty result.  Memory in a task is one Arrow batch and a few
    arrays as long as a slice of it, or as the longest text; there is no shuffle.
    """
    limits = dict(limits or NGRAM_LIMITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
        for b in text_batches(batches):
            texts = [t or "" for t in b["text"]]
            h, start, end, ends = hash_words(texts)
            rows = [measure(*x, limits, line_limit) for x in zip(texts, per_text(h, ends), per_text(characters(texts, start, end), ends))]
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    picked = texts_to_python(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInPandas(run, SCHEMA)


def op8_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition_coverage(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_share")
