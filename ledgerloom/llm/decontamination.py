"""Benchmark decontamination by spaced seeds: overlaps with test passages that survive word substitutions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_words, mix, per_text, stage, text_batches, texts_to_python

#: Fixed masks by span: 1 is a token that counts, 0 one that is ignored.  An item of four tokens or more uses all
#: spans from 4 that fit.  They miss nothing at an identity of 4 in 5: a segment of 5 q + r tokens has q other tokens
#: at most, so one of its q blocks of five has one at most, and the masks cover each place where that can be.
MASKS = {
    5: ("11011", "10111", "11101"),
    4: ("1111",),
    3: ("111",),
}
#: An overlap counts when it is this similar, and long enough: MIN_TOKENS tokens, or MIN_SHARE of the item.
MIN_IDENTITY, MIN_TOKENS, MIN_SHARE = 0.8, 13, 0.8
#: Tokens of the benchmark that one pass over the documents holds, at about 80 bytes each (the hash, and 4 masks of 16).
BLOCK_TOKENS = 1_000_000
HITS = "doc_start int, item_start int, n_tokens int, n_equal int"


def seeded(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hashes of every window of word hashes `h` under `mask`; ignored positions take no part."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, salt, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[j : j + m]
    return mix(out)


class Index:
    """Hashes of a block of test items, sorted, with their places."""

    BITS = 22

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in items]
        self.tokens, _, _, ends = hash_words([t for _, t in items], fold=True)
        tokens = per_text(self.tokens, ends)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.concatenate([[0], ends]).astype(np.int64)
        keys, where, self.spans = [np.empty(0, np.uint64)], [np.empty((0, 2), np.int32)], set()
        for k, t in enumerate(tokens):
            for span in (s for s in MASKS if s <= len(t) and (s > 3 or len(t) == 3)):
                self.spans.add(span)
                for n, mask in enumerate(MASKS[span]):
                    x = seeded(t, mask, span * 16 + n)
                    keys.append(x)
                    where.append(np.stack([np.full(len(x), k, np.int32), np.arange(len(x), dtype=np.int32)], 1))
        self.keys, self.where = np.concatenate(keys), np.concatenate(where)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.where = self.keys[order], self.where[order]
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[(self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct (document, item, document position - item position) of seeds of `h` that meet a seed of an item.

        `h` holds the documents' word hashes one after another, `ends` where each document ends.
        """
        found = []
        begins = np.concatenate([[0], ends[:-1]])
        for span in self.spans:
            for n, mask in enumerate(MASKS[span]):
                x = seeded(h, mask, span * 16 + n)
                at = np.flatnonzero(self.bits[(x >> np.uint64(64 - self.BITS)).astype(np.int64)])
                doc = np.searchsorted(ends, at, "right")
                inside = at + span <= ends[doc]
                at, doc = at[inside], doc[inside]
                low, high = np.searchsorted(self.keys, x[at], "left"), np.searchsorted(self.keys, x[at], "right")
                count = high - low
                if not count.any():
                    continue
                rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                item, place = self.where[rows].astype(np.int64).T
                found.append(np.stack([np.repeat(doc, count), item, np.repeat(at - begins[doc], count) - place], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)

    def verify(self, h: np.ndarray, item: int, shift: int) -> tuple[int, int, int, int] | None:
        """The longest overlap on one diagonal: (start in document, start in item, tokens, equal tokens), if it counts.

        It is the longest segment (the first of equals) that agrees in MIN_IDENTITY of its tokens.  In whole
        numbers, equal tokens score 1 and others -4 at an identity of 4 in 5, so a segment agrees when its sum is
        not negative; for each end, the earliest fitting start is searched for in the running minima of the sums.
        """
        t = self.tokens[self.begin[item] : self.begin[item + 1]]
        a, b = max(0, -shift), min(len(t), len(h) - shift)
        equal = t[a:b] == h[a + shift : b + shift]
        share = Fraction(str(MIN_IDENTITY))
        total = np.concatenate([[0], np.cumsum(np.where(equal, share.denominator - share.numerator, -share.numerator))])
        begin = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
        length = np.arange(len(total)) - begin
        end = int(length.argmax())
        start, tokens = int(begin[end]), int(length[end])
        if tokens and tokens >= min(MIN_TOKENS, Fraction(str(MIN_SHARE)) * len(t)):
            return a + shift + start, a + start, tokens, int(equal[start:end].sum())
        return None


    def overlaps(self, texts: list[str | None]) -> Iterator[tuple[int, int, tuple[int, int, int, int]]]:
        """(text, item, overlap) of every diagonal of these texts on which an overlap counts."""
        h, _, _, ends = hash_words(texts, fold=True)
        words = per_text(h, ends)
        for k, item, shift in self.hits(h, ends).tolist():
            if v := self.verify(words[k], item, shift):
                yield k, item, v


def blocks(benchmark: DataFrame, id_col: str, text_col: str, tokens: int) -> Iterator[list[tuple[object, str]]]:
    """Test items in blocks of about `tokens` words (one longer item is a block); the driver holds one block at a time."""
    held, size = [], 0
    for r in benchmark.select(benchmark[id_col].alias("i"), benchmark[text_col].cast("string").alias("t")).filter("i is not null and t is not null").toLocalIterator():
        n = len(r["t"].split())
        if held and size + n > tokens:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    if held:
        yield held


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row for each (document, test item) that overlap, with the best overlap in tokens.

    Tokens are words in lower case without punctuation at the ends.  Every window of a document is hashed under
    the fixed masks and joined to the hashes of the benchmark's windows; around each hit the two texts are
    compared token by token along the diagonal.  An overlap counts when a segment of MIN_TOKENS tokens (or
    MIN_SHARE of a shorter item) agrees in MIN_IDENTITY of its tokens, substitutions allowed.  Of several overlaps
    with one item, the one with the most equal tokens is reported, of equal ones the first in the document.

    The benchmark is a stated query set: it is taken in blocks of `block_tokens` words, each broadcast as sorted
    hashes, and every block meets all documents.  With more than one block, each block's rows are written before
    the next block is sent, so a worker holds one block however large the benchmark is.  Items of fewer than three
    tokens are not searched for.  Ids keep their types.  Null texts and null item ids match nothing; null document
    ids are reported as null; repeated documents repeat their rows; of repeated items each is reported once for
    each id.  Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    picked = texts_to_python(docs).select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).filter("text is not null")
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_id].dataType.simpleString()}, {HITS}"

    def search(items: list[tuple[object, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = held.value
            for b in text_batches(batches):
                best: dict[tuple[int, object], tuple] = {}
                for k, item, v in index.overlaps(b["text"].tolist()):
                    key = (k, index.ids[item])
                    if key not in best or (v[3], -v[0]) > (best[key][3], -best[key][0]):
                        best[key] = v
                ids = b["doc_id"].astype(object).where(b["doc_id"].notna(), None).tolist()
                out = pd.DataFrame([(ids[k], i, *v) for (k, i), v in best.items()], columns=["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"])
                yield out.astype({"doc_id": "Int64"}) if b["doc_id"].dtype.kind in "if" else out

        return picked.mapInPandas(run, schema)

    held = blocks(benchmark, item_id, item_text, block_tokens)
    first, second = next(held, None), next(held, None)
    if second is None:
        return search(first) if first else spark.createDataFrame([], schema)
    out = stage(search(first), "overlaps")
    for items in itertools.chain([second], held):
        out = out.unionByName(stage(search(items), "overlaps"))
    return out


def clean(held):
    """A pandas UDF that is true for texts that overlap no item of the broadcast index."""

    @F.pandas_udf("boolean")
    def test(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = held.value
        for text in texts:
            out = np.ones(len(text), bool)
            for b in text_batches([pd.DataFrame({"row": np.arange(len(text)), "text": text.to_numpy()})]):
                rows = b["row"].to_numpy()
                for k, _, _ in index.overlaps(b["text"].tolist()):
                    out[rows[k]] = False
            yield pd.Series(out)

    return test


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """`docs` without the rows that overlap a test item; all columns stay, and rows with null or empty texts.

    Each row is judged by its own text, so repeated rows go or stay together and ids play no part.  With more than
    one block of the benchmark, what a block leaves is written before the next is sent.  There is no shuffle.
    """
    docs, seen = texts_to_python(docs), None
    for items in blocks(benchmark, item_id, item_text, block_tokens):
        docs = stage(docs, "clean") if seen else docs
        seen = docs.sparkSession.sparkContext.broadcast(Index(items))
        docs = docs.filter(clean(seen)(docs[text_col].cast("string")))
    return docs


def op9_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
