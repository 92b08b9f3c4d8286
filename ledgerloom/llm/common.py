"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in an Arrow batch of whole texts, and characters of texts that a task works on at once; one longer text is taken alone.
BATCH_BYTES, SLICE_CHARS = 4 << 20, 500_000
#: A key is hot when it holds this share of all rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000
#: Word of the polynomial hash over word windows.
BASE = np.uint64(0x9E3779B97F4A7C15)


# --------------------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session (tests, one machine) gets a folder of its own, and a cluster an error: a
    folder of one machine would lose what other executors write.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = held.rsplit("/", 1)[0] if held else tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back, which cuts its lineage.

    The files outlive the executors that wrote them, so a lost executor costs a reread only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_to_python(df: DataFrame) -> DataFrame:
    """`df`, whose rows hold whole texts that go to Python: from now on an Arrow batch ends at BATCH_BYTES.

    Spark's default is 10,000 rows whatever their size, so that an executor would hold batches of a hundred
    megabytes in the JVM and in each worker.  Spark has this limit for the session only; a smaller one stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    held = str(conf.get(key)).lower().removesuffix("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def text_batches(batches: Iterator[pd.DataFrame], most: int = SLICE_CHARS) -> Iterator[pd.DataFrame]:
    """Batches with a column text in slices of about `most` characters, so that a task's memory is bounded by bytes."""
    for b in batches:
        group = np.cumsum([len(t) if t else 0 for t in b["text"]]) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(b)]
        for x, y in zip(cuts, cuts[1:]):
            if x < y:
                yield b.iloc[x:y]


# --------------------------------------------------------------------------- skew
def attach(rows: DataFrame, keyed: DataFrame, key: str, count: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """Join `rows` to `keyed` (one row for each key) on `key`, whatever share of `rows` one key holds.

    `keyed` has in column `count` the number of `rows` with that key.  Keys with at least HOT_SHARE of all
    counted rows number at most 1 / HOT_SHARE by arithmetic; they are broadcast, and the rest are joined by a
    shuffle in which no key is large.  `total` is the sum of `count`, where the caller knows it; `count` is dropped.  Null keys match nothing; how="left" keeps all rows.
    """
    if total is None:
        total = keyed.agg(F.sum(count)).first()[0] or 0
    least = max(1.0, total * HOT_SHARE)
    hot = keyed.filter(F.col(count) >= least).drop(count).withColumn("_hot", F.lit(True))
    rest = keyed.filter(F.col(count) < least).drop(count)
    marked = rows.join(F.broadcast(hot), key, "left")
    names = [c for c in keyed.columns if c not in (key, count)]
    found = marked.filter("_hot").select(*rows.columns, *names)
    other = marked.filter("_hot is null").select(*rows.columns)
    if how == "left":
        empty = other.filter(F.col(key).isNull())
        for c in names:
            empty = empty.withColumn(c, F.lit(None).cast(keyed.schema[c].dataType))
        joined = other.filter(F.col(key).isNotNull()).join(rest, key, "left").select(*rows.columns, *names)
        return found.unionByName(joined).unionByName(empty.select(*rows.columns, *names))
    return found.unionByName(other.join(rest, key).select(*rows.columns, *names))


# --------------------------------------------------------------------------- words
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Punctuation that folding takes off the ends of words.
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\"'()[]{}<>")] = True
STEP, BACK = np.uint64(0x9FB21C651E98DF25), np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers of STEP and of its inverse, modulo 2^64; a worker keeps those of a slice."""
    have = _powers
    if len(have[0]) < n:
        have = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)])) for x in (STEP, BACK)]
        if n <= 8 * SLICE_CHARS:
            _powers[:] = have
    return have[0][:n], have[1][:n]


def hash_spans(byte: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: polynomials in the bytes, read off the running sums of all of them."""
    up, down = powers(len(byte) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((byte.astype(np.uint64) + np.uint64(1)) * down[:-1])])
    return mix((total[end] - total[start]) * up[start]) | np.uint64(1)


def hash_words(texts: list[str | None], fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of `texts`: 64-bit hashes, first bytes, ends (in the joined UTF-8 text), and where each text's words end.

    Words are runs of bytes other than ASCII white space; none becomes a Python object.  With `fold`, words are lower-cased, lose
    punctuation at their ends, and those that are nothing else are left out.
    """
    raws = [((t.lower() if fold else t) if t else "").encode("utf-8", "replace") for t in texts]
    byte = np.frombuffer(b" ".join([*raws, b""]) or b" ", np.uint8)
    space = SPACE[byte]
    word = ~space
    start = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(word & np.concatenate([space[1:], [True]])) + 1
    if fold:
        solid, at = word & ~ENDS[byte], np.arange(len(byte))
        after = np.minimum.accumulate(np.where(solid, at, len(byte))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(solid, at, -1))
        start, end = after[start] if len(start) else start, before[end - 1] + 1 if len(end) else end
        held = start < end
        # a word of punctuation alone: what is solid next to it lies in other words
        held &= np.concatenate([[True], start[1:] >= np.maximum.accumulate(end)[:-1]]) if len(start) else held
        start, end = start[held], end[held]
    stops = np.cumsum([len(r) + 1 for r in raws]) if raws else np.empty(0, np.int64)
    return hash_spans(byte, start, end), start, end, np.searchsorted(start, stops, "left")


def per_text(flat: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The part of `flat` that belongs to each text."""
    return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of every n-word window of word hashes `h` (empty when there are fewer words)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= BASE
        out += h[j : j + m]
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a polynomial hash depend on all words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def repeated(h: np.ndarray) -> np.ndarray:
    """Marks the entries of `h` that occur twice or more."""
    if len(h) < 2:
        return np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Marks the positions below `total` that lie in a window of n which begins where `starts` is true."""
    begun = np.concatenate([[0], np.cumsum(starts)])
    at = np.arange(total)
    return begun[np.minimum(at + 1, len(starts))] > begun[np.clip(at - n + 1, 0, len(starts))]
