"""N-gram Jaccard join: a MinHash LSH forest proposes, exact verification disposes.

Every distinct text has `trees` labels, each a sequence of min-hash values: the paths of prefix tries.  Texts that
share a prefix in some tree stand below one node of its trie and are candidates.  The search begins with the longest
prefixes.  Verified links say how likely each of them was to be found, which estimates how many there are; as long as
too many are missing, prefixes are shortened by one value, down to the length that finds a pair at the threshold
with the target chance.

A trie node is led by its least document.  Texts travel to the leaders of their nodes, not to one another: each
leader's followers are split into blocks, and each pair of blocks is compared by one matrix product.  Only counts
of links and the edges of a spanning forest leave a block, so a group of copies never turns into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, hash_words, mix, per_text, stage, text_batches, texts_to_python, windows
from .components import components

WORDS, THRESHOLD, TREES, MAX_DEPTH, TARGET = 5, 0.8, 24, 8, 0.999
#: Texts and shingles in a block of followers, on average; two blocks are compared in one task's memory.
BLOCK, BLOCK_SHINGLES = 512, 400_000


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its word n-grams; a shorter text with words is one shingle of all of them."""
    h, _, _, ends = hash_words(texts)
    return [np.unique(windows(x, min(words, len(x)))) if len(x) else x for x in per_text(h, ends)]


def digest_of(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode("utf-8", "replace"))


def recall(depth: int, trees: int, similarity):
    """Chance that a pair of this similarity shares a prefix of `depth` values in one of `trees` trees."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float, trees: int, target: float, most: int = MAX_DEPTH) -> int:
    """The longest prefix that finds a pair at the threshold with the target chance: none need be shorter."""
    return next((d for d in range(most, 1, -1) if recall(d, trees, threshold) >= target), 1)


class Forest:
    """Min-hash labels: `trees` times `depth` values of 32 bits."""

    def __init__(self, trees: int, depth: int):
        rng = np.random.default_rng(20_251)
        n = trees * depth
        self.trees, self.depth = trees, depth
        self.a = (rng.integers(1, 1 << 32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """Labels of a set of mixed hashes: the least values of `trees` times `depth` linear functions of them."""
        low = (s >> np.uint64(16)).astype(np.uint32)[None, :]
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(s), 512):
            x = self.a * low[:, k : k + 512]
            x += self.b
            out = np.minimum(out, x.min(1))
        return out.reshape(self.trees, self.depth)

    def prefixes(self, labels: np.ndarray, depth: int) -> list[int]:
        """One 64-bit key for each tree: the tree and the first `depth` values of its label."""
        key = np.arange(1, self.trees + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for j in range(depth):
            key = mix(key ^ labels[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return key.view(np.int64).tolist()


def signed(docs: DataFrame, trees: int, depth: int, words: int) -> DataFrame:
    """doc_id, 128-bit digest of the text, its number of shingles, and its labels (null when the text has no word)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest(trees, depth)
        for b in text_batches(batches):
            digest = [digest_of(t) for t in b["text"]]
            first = {d: k for k, d in reversed(list(enumerate(digest)))}
            texts = b["text"].tolist()
            sets = dict(zip(first, shingle_sets([texts[k] for k in first.values()], words)))
            labels = {d: forest(s).astype("<u4").tobytes() if len(s) else None for d, s in sets.items()}
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "digest": digest, "shingles": [len(sets[d]) for d in digest], "labels": [labels[d] for d in digest]})

    return docs.mapInPandas(run, "doc_id long, digest binary, shingles long, labels binary")


def node_rows(texts: DataFrame, trees: int, stored: int, depth: int) -> DataFrame:
    """(node, rep, shingles) for each tree of each text: the trie node at `depth` that the text stands below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest(trees, stored)
        for b in batches:
            keys = [forest.prefixes(np.frombuffer(x, "<u4").reshape(trees, stored), depth) for x in b["labels"]]
            yield pd.DataFrame({"node": np.array(keys, np.int64).ravel(), "rep": np.repeat(b["rep"].to_numpy(), trees), "shingles": np.repeat(b["shingles"].to_numpy(), trees)})

    return texts.select("rep", "shingles", "labels").mapInPandas(run, "node long, rep long, shingles long")


# --------------------------------------------------------------------------- verification
def overlaps(rows: list[np.ndarray], cols: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets in `rows` with all in `cols`, by products of 0/1 matrices."""
    out = np.zeros((len(rows), len(cols)), np.float32)
    if not rows or not cols:
        return out
    flat_r, flat_c = np.concatenate(rows), np.concatenate(cols)
    shared = np.intersect1d(flat_r, flat_c)
    of_r, of_c = np.repeat(np.arange(len(rows)), list(map(len, rows))), np.repeat(np.arange(len(cols)), list(map(len, cols)))
    at_r, at_c = np.searchsorted(shared, flat_r), np.searchsorted(shared, flat_c)
    if not len(shared):
        return out
    in_r, in_c = shared[np.minimum(at_r, len(shared) - 1)] == flat_r, shared[np.minimum(at_c, len(shared) - 1)] == flat_c
    of_r, at_r, of_c, at_c = of_r[in_r], at_r[in_r], of_c[in_c], at_c[in_c]
    for k in range(0, len(shared), width):
        m_r, m_c = np.zeros((len(rows), min(width, len(shared) - k)), np.float32), np.zeros((len(cols), min(width, len(shared) - k)), np.float32)
        pick = (at_r >= k) & (at_r < k + width)
        m_r[of_r[pick], at_r[pick] - k] = 1
        pick = (at_c >= k) & (at_c < k + width)
        m_c[of_c[pick], at_c[pick] - k] = 1
        out += m_r @ m_c.T
    return out


def compare(leader: int, left: list[tuple], right: list[tuple], same: bool, threshold: float) -> tuple[dict[int, int], list[tuple[int, int]], list[float]]:
    """Links between two blocks of (rep, leaders, shingles): counts by text, forest edges, and similarities.

    A pair that also meets at a smaller leader is left to that one, so every link is counted once.
    """
    counts: dict[int, int] = {}
    inter = overlaps([x[2] for x in left], [x[2] for x in right])
    size_l, size_r = np.array([len(x[2]) for x in left], np.float32), np.array([len(x[2]) for x in right], np.float32)
    sim = inter / np.maximum(size_l[:, None] + size_r[None, :] - inter, 1)
    link = sim >= np.float32(threshold - 1e-6)
    id_l, id_r = np.array([x[0] for x in left]), np.array([x[0] for x in right])
    link &= id_l[:, None] != id_r[None, :]
    if same:
        link = np.triu(link, 1)
    smaller = sorted({m for x in left for m in x[1] if m < leader} & {m for x in right for m in x[1] if m < leader})
    if smaller:
        at = {m: k for k, m in enumerate(smaller)}
        m_l, m_r = np.zeros((len(left), len(smaller)), np.float32), np.zeros((len(right), len(smaller)), np.float32)
        for m, block in ((m_l, left), (m_r, right)):
            for k, x in enumerate(block):
                for v in x[1]:
                    if v in at:
                        m[k, at[v]] = 1
        link &= (m_l @ m_r.T) == 0
    r, c = np.nonzero(link)
    if not len(r):
        return counts, [], []
    for ids, n in ((id_l, link.sum(1)), (id_r, link.sum(0))):
        for i, k in zip(ids.tolist(), n.tolist()):
            if k:
                counts[i] = counts.get(i, 0) + int(k)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for a, b in zip(id_l[r].tolist(), id_r[c].tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    edges = [(x, root(x)) for x in list(parent) if root(x) != x]  # the least member leads, so most blocks are one star
    return counts, edges, sim[r, c].tolist()


LINKS = "a long, b long, n long, expected double"


def verified(pairs: DataFrame, threshold: float, trees: int, depth: int) -> DataFrame:
    """Compare blocks.  `pairs` has leader, i, j, side (0 or 1), rep, leaders, shingles; equal (leader, i, j) are adjacent.

    Rows out: (text, null, links of it, null), forest edges (a, b, 0, null), and (null, null, links, what the
    links weigh when each counts as one over its chance of having been found).
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, tuple[list, list]]]:
        key, sides, held = None, ([], []), (set(), set())
        for b in batches:
            for leader, i, j, side, rep, leaders, s in zip(*(b[c].tolist() for c in ("leader", "i", "j", "side", "rep", "leaders", "shingles"))):
                if (leader, i, j) != key:
                    if key is not None:
                        yield key, sides
                    key, sides, held = (leader, i, j), ([], []), (set(), set())
                mark = (rep, xxhash.xxh3_64_intdigest(s))
                if mark not in held[side]:  # rows that repeat a document repeat its set
                    held[side].add(mark)
                    sides[side].append((rep, list(leaders), np.frombuffer(s, "<u8")))
        if key is not None:
            yield key, sides

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["a", "b", "n", "expected"]
        rows: list[tuple] = []
        for (leader, i, j), (left, right) in blocks(batches):
            counts, edges, sims = compare(leader, left, left if i == j else right, i == j, threshold)
            rows += [(a, None, n, None) for a, n in counts.items()] + [(a, b, 0, None) for a, b in edges]
            if sims:
                rows.append((None, None, len(sims), float((1 / recall(depth, trees, np.array(sims))).sum())))
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=names).astype({"a": "Int64", "b": "Int64"})
                rows = []
        yield pd.DataFrame(rows, columns=names).astype({"a": "Int64", "b": "Int64", "n": "Int64", "expected": "float64"})

    return pairs.mapInPandas(run, LINKS)


def links_at(texts: DataFrame, docs: DataFrame, trees: int, stored: int, depth: int, words: int, threshold: float) -> DataFrame:
    """Verified links between texts that share a prefix of `depth` values."""
    rows = node_rows(texts, trees, stored, depth)
    led = rows.groupBy("node").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    led = stage(led, "nodes")
    follow = attach(rows, led, "node", "n").select("rep", "leader", "shingles").distinct()
    follow = stage(follow, "followers")
    # blocks of a leader's followers
    size = follow.groupBy("leader").agg(F.count("*").alias("n"), F.sum("shingles").alias("total")).filter("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    sized = attach(follow.drop("shingles"), size.select("leader", "n", parts.alias("parts")), "leader", "n")
    leaders = sized.groupBy("rep").agg(F.collect_list(F.struct("leader", "parts")).alias("led")).join(texts.select("rep", "digest"), "rep")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in text_batches(batches):
            b = b[[digest_of(t) == d for t, d in zip(b["text"], b["digest"])]]  # a repeated id may have other texts
            out = b[["rep", "led"]].copy()
            out["shingles"] = [s.astype("<u8").tobytes() for s in shingle_sets(b["text"].tolist(), words)]
            yield out

    with_text = leaders.join(docs, leaders["rep"] == docs["doc_id"]).select("rep", "digest", "led", "text")
    held = with_text.mapInPandas(cut, "rep long, led array<struct<leader:long,parts:int>>, shingles binary")
    own = held.select("rep", F.col("led.leader").alias("leaders"), "shingles", F.explode("led").alias("l"))
    part = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("l.parts")).cast("int")
    spread = own.select("rep", "leaders", "shingles", F.col("l.leader").alias("leader"), part.alias("p"), F.explode(F.sequence(F.lit(0), F.col("l.parts") - 1)).alias("q"))
    pairs = spread.select(
        "leader", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), F.when(F.col("p") <= F.col("q"), 0).otherwise(1).alias("side"), "rep", "leaders", "shingles"
    )
    tasks = pairs.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "side")
    return stage(verified(tasks, threshold, trees, depth), "links")


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    target: float = TARGET,
) -> DataFrame:
    """One row for each row of `docs`: doc_id, class_id, n_links, rep_id.

    A link joins two different texts whose sets of `words`-word shingles have a Jaccard similarity of at least
    `threshold`, computed exactly (words are separated by white space, case counts).  class_id is the least
    doc_id that links and copies lead to, n_links the number of other texts linked to this one, and rep_id the
    least doc_id with the same text.  Each link is found with a chance of at least `target`.

    Rows without a word, or with a null text, are linked to nothing and are classes of their own (as are null
    ids, whose class is null); so are unique texts, with n_links 0.  A text of fewer words is one shingle of all
    of them.  Rows that repeat a doc_id are one document: its links are those of all its texts.  An empty table
    gives an empty result; other columns are not read.
    """
    stored = depth = MAX_DEPTH
    rows = texts_to_python(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    known = rows.filter("doc_id is not null")
    held = stage(signed(known, trees, stored, words), "labels")
    # copies collapse before anything is compared
    reps = stage(held.filter("labels is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    texts = held.join(reps.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"])
    texts = stage(texts.select(F.col("doc_id").alias("rep"), "digest", "shingles", "labels"), "texts")
    while True:
        links = links_at(texts, known, trees, stored, depth, words, threshold)
        found = links.filter("expected is not null").agg(F.sum("n").alias("n"), F.sum("expected").alias("expected")).first()
        # each link counts as one over its chance of being found: an unbiased estimate of how many there are
        if depth <= least_depth(threshold, trees, target) or found["n"] and found["n"] >= target * found["expected"]:
            break
        depth -= 1
    count = links.filter("a is not null and b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    root = components(links.filter("b is not null").select("a", "b")).withColumnsRenamed({"node": "rep", "root": "class_id"})
    linked = count.join(root, "rep", "full")
    of_text = reps.join(linked, "rep", "left").select("digest", "rep", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies")
    of_text = stage(of_text, "classes")
    out = attach(held.select("doc_id", "digest"), of_text, "digest", "copies", how="left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("rep", "doc_id").alias("rep_id"))
    none = rows.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("rep_id"))
    return out.unionByName(none)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each class, the one with the least id; unlinked rows all stay, columns too."""
    joined = jaccard_join(docs, id_col, text_col, **options)
    gone = joined.filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("_gone"), "left_anti")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
