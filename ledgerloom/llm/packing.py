"""Best-fit packing of tokenized documents into sequences of a fixed length.

A configuration is a multiset of piece lengths that fits one sequence.  The configuration linear program over
the histogram of lengths is solved by multiplicative weights whose pricing step is a knapsack dynamic program;
its solution is rounded to whole sequences, solved again for what is left, and the last pieces are packed best-fit
decreasing.  The histogram has one entry for each length, so the program does not grow with the documents.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_spans, stage, text_batches, texts_to_python

SEQUENCE = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Parts of text that a task remembers, at about 150 bytes each; beyond it forgets the later half, which is the rarer.
PARTS = 300_000
#: Words encoded at once: what the tokenizer returns takes far more memory than the ids.
TOGETHER = 2_000
#: Kinds of bytes of lower-case UTF-8: white space, letters (two-byte ones by their first byte), digits, other, odd.
BLANK, LETTER, DIGIT, OTHER, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[33:127] = OTHER
KIND[[9, 10, 11, 12, 13, 32]] = BLANK
KIND[ord("a") : ord("z") + 1] = KIND[[0xC3, 0xC4]] = LETTER
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[[ord("'"), *range(ord("A"), ord("Z") + 1)]] = ODD


def parts(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds of the parts into which the tokenizer separates lower-case UTF-8 text.

    Runs of Latin letters, single digits and runs of other ASCII characters are parts.  A chunk between white space
    that holds anything else (wide characters, control characters, apostrophes, marks of special tokens) is one odd part.
    """
    kind = KIND[byte]
    before = np.concatenate([byte[:1], byte[:-1]])
    # second bytes of letters from U+00C0 to U+012F; U+00D7 and U+00F7 are signs
    letter = (before == 0xC3) & (byte >= 0x80) & (byte <= 0xBF) & (byte != 0x97) & (byte != 0xB7) | (before == 0xC4) & (byte >= 0x80) & (byte <= 0xAF)
    kind[letter] = LETTER
    kind[(before == ord("<")) & (byte == ord("|"))] = ODD
    blank = kind == BLANK
    begins = ~blank & np.concatenate([[True], blank[:-1]])
    chunk = np.cumsum(begins)
    odd = np.zeros(int(chunk[-1]) + 1, bool)
    odd[chunk[kind == ODD]] = True
    kind[odd[chunk] & ~blank] = ODD
    start = ~blank & (begins | (kind == DIGIT) | np.concatenate([[True], kind[1:] != kind[:-1]]))
    end = ~blank & np.concatenate([start[1:] | blank[1:], [True]])
    start = np.flatnonzero(start)
    return start, np.flatnonzero(end) + 1, kind[start]


@functools.cache
def tokenizers_of(path: str):
    """The tokenizer, its model alone behind a split at spaces, and which ids end words: fixed, so a worker loads them once."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    model = Tokenizer(whole.model)
    model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    vocabulary = whole.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
    # the byte level's spelling of the second bytes of two-byte characters, where it is not the byte itself
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    moved = {chr(b): level.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1] for b in range(0x80, 0xC0)}
    return whole, model, ends, {b: c for b, c in moved.items() if b != c}


class Ids:
    """Token ids of texts as little-endian 32-bit numbers, by way of the ids of parts, which a task remembers.

    The tokenizer lower-cases, drops white space and never joins what it separates, so the ids of a text are those
    of its parts, one after another.  Parts are found and hashed (64 bits) over the bytes of many texts at once; only
    new ones become Python objects.  New words go to the tokenizer's model many at a time (spelled as its byte level
    spells them); each ends with a token that ends words, and that is where their ids are cut apart.  All other parts
    go to the whole tokenizer.
    """

    def __init__(self, path: str):
        self.whole, self.model, self.ends, self.moved = tokenizers_of(path)
        self.place: dict[int, int] = {}  # number of each known part by hash
        self.ids, self.at = np.zeros(1, np.uint32), np.array([0, 1])  # ids of all parts; part 0 is what ends a text

    def learn(self, words: list[bytes], others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, then of other new parts, one after another, and how many each has."""
        ids, sizes = [], []
        for listed in itertools.batched(words, TOGETHER):
            text = b" ".join(listed).decode("latin-1")
            for b in self.moved.keys() & set(text):
                text = text.replace(b, self.moved[b])
            found = np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            size = np.diff(np.flatnonzero(self.ends[found]), prepend=-1)
            found, size = (found, size) if len(size) == len(listed) else self.one_by_one(listed)
            ids.append(found)
            sizes.append(size)
        found, size = self.one_by_one(others)
        return np.concatenate([*ids, found]), np.concatenate([*sizes, size])

    def one_by_one(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the whole tokenizer, of each text alone, and how many each has."""
        each = [e.ids for e in self.whole.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)] if texts else []
        return np.array(list(itertools.chain.from_iterable(each)), np.uint32), np.array(list(map(len, each)), np.int64)

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, then id 0."""
        # the tokenizer lower-cases each character alone, so a sigma that ends a word is not special
        raws = [t.replace("Σ", "σ").lower().encode("utf-8", "replace") if t else b"" for t in texts]
        raw = b" ".join([*raws, b""])
        start, end, kind = parts(np.frombuffer(raw, np.uint8))
        seen, first, part = np.unique(hash_spans(np.frombuffer(raw, np.uint8), start, end), return_index=True, return_inverse=True)
        if len(self.place) > PARTS:
            keep = PARTS // 2
            self.place = dict(itertools.islice(self.place.items(), keep))
            self.at = self.at[: keep + 2].copy()
            self.ids = self.ids[: self.at[-1]].copy()
        number = np.fromiter(map(self.place.get, seen.tolist(), itertools.repeat(-1)), np.int64, len(seen))
        new = np.flatnonzero(number < 0)
        if len(new):
            word = kind[first[new]] == LETTER
            order, n = np.concatenate([new[word], new[~word]]), int(word.sum())
            held = [raw[a:b] for a, b in zip(start[first[order]].tolist(), end[first[order]].tolist())]
            ids, sizes = self.learn(held[:n], held[n:])
            number[order] = len(self.at) - 1 + np.arange(len(order))
            self.place.update(zip(seen[order].tolist(), number[order].tolist()))
            self.ids = np.concatenate([self.ids, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        number = number[part]
        stops = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws]), "left")
        number = np.insert(number, stops, 0)
        size = self.at[number + 1] - self.at[number]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[number] - total[:-1], size) + np.arange(total[-1])].astype("<u4")
        ends = total[stops + np.arange(1, len(texts) + 1)].tolist()
        for a, b in zip([0, *ends], ends):
            yield ids[a:b]


def cut(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each row of `docs`: its place in the document, length and CRC-32.

    `task` is the task that made the row and `own` its number among that task's pieces of its length; they are
    written with the row, so they number equal rows apart, however many there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, task, made = Ids(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in text_batches(batches):
            out = []
            for d, raw in zip(b["doc_id"].tolist(), (x.tobytes() for x in ids(b["text"].tolist()))):
                d = None if d != d else d
                for k, a in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[a : a + 4 * size]
                    n = len(part) // 4
                    out.append((d, k, k * size, n, zlib.crc32(part), task, int(made[n])))
                    made[n] += 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "own"]).astype({"doc_id": "Int64"})

    picked = texts_to_python(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInPandas(run, PIECES + ", task int, own long")


# --------------------------------------------------------------------------- the linear program
#: Uses of a configuration pack this share of the scarcest of its lengths; volume that the program may leave to best fit.
STEP, LEFT = 0.25, 0.02


def knapsack(lengths: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Unbounded knapsack over lengths in descending order.

    The best value of each capacity; the item taken last to reach it (-1: none); and the largest capacity not above
    it at which one is taken, from which the items are traced.
    """
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    first = np.searchsorted(-lengths, -np.arange(size + 1), "left")  # the longest item that a capacity holds
    for c in range(1, size + 1):
        best[c], k = best[c - 1], first[c]
        if k < len(lengths):
            v = best[c - lengths[k:]] + value[k:]
            if v[j := int(v.argmax())] > best[c]:
                best[c], last[c] = v[j], k + j
    return best, last.tolist(), np.maximum.accumulate(np.where(last >= 0, np.arange(size + 1), 0)).tolist()


def solve(lengths: np.ndarray, counts: np.ndarray, size: int, step: float = STEP, leave: float = LEFT) -> dict[tuple[int, ...], float]:
    """Fractional packing of `counts` (of lengths in descending order) into configurations (tuples of indexes).

    The dual prices are the multiplicative weights: a length's price falls exponentially with the share of it that
    is packed, and is nothing once all of it is.  Each round prices configurations with one knapsack, and every
    length that lags behind takes the best configuration that holds it, until `step` of it, or all of another of
    the configuration's lengths, is packed.  Every use advances a length by a step or finishes one, so the rounds
    end by themselves: when less than the share `leave` of the volume is not packed.
    """
    use: dict[tuple[int, ...], float] = {}
    share, eta = np.zeros(len(lengths)), np.log(len(lengths) + 2)
    size_of, count = lengths.tolist(), counts.tolist()
    volume = lengths * counts
    while ((1 - share) * volume).sum() > leave * volume.sum():
        at = np.flatnonzero(share < 1)
        low = share[at].min()
        _, last, room = knapsack(lengths[at], lengths[at] * np.exp(-eta * (share[at] - low)), size)
        name = at.tolist()
        for k in at[share[at] <= low + step].tolist():
            if share[k] > low + step:
                continue
            held, c = Counter([k]), room[size - size_of[k]]
            while c > 0:
                held[name[last[c]]] += 1
                c = room[c - size_of[name[last[c]]]]
            config = {i: min(n, count[i]) for i, n in held.items()}  # no more of a length than there is
            key = tuple(sorted(i for i, n in config.items() for _ in range(n)))
            while share[k] <= low + step and (x := min(min(1 - share[i], step) * count[i] / n for i, n in config.items())) > 1e-12:
                use[key] = use.get(key, 0.0) + x
                for i, n in config.items():
                    share[i] += n * x / count[i]
                    if share[i] > 1 - 1e-9:
                        share[i] = 1
    return use


def rounded(use: dict[tuple[int, ...], float], lengths: np.ndarray, left: np.ndarray, most: int) -> dict[tuple[int, ...], int]:
    """At most `most` whole uses of a solution's configurations, fullest first, then largest fractions; `left` is lowered."""
    whole: dict[tuple[int, ...], int] = {}
    fill = {c: sum(int(lengths[k]) for k in c) for c in use}
    for again in (False, True):
        for config, x in sorted(use.items(), key=lambda c: (-fill[c[0]], int(c[1]) - c[1] if again else -c[1], c[0])):
            items, n = np.unique(config, return_counts=True)
            if (times := int(min(1 if again else x, most, (left[items] // n).min()))) > 0:
                whole[config] = whole.get(config, 0) + times
                left[items] -= n * times
                most -= times
    return whole


def best_fit(lengths: np.ndarray, left: np.ndarray, size: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing over a histogram: groups of equal sequences are filled together."""
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # sorted room sizes that have open sequences

    def put(room: int, config: tuple[int, ...], n: int) -> None:
        if room not in open_at:
            open_at[room] = []
            bisect.insort(rooms, room)
        open_at[room].append((config, n))

    for k in range(len(lengths) - 1, -1, -1):
        n, size_k = int(left[k]), int(lengths[k])
        while n:
            at = bisect.bisect_left(rooms, size_k)
            if at == len(rooms):
                each = size // size_k
                full, rest = divmod(n, each)
                if full:
                    put(size - each * size_k, (k,) * each, full)
                if rest:
                    put(size - rest * size_k, (k,) * rest, 1)
                break
            room = rooms[at]
            config, m = open_at[room].pop()
            if not open_at[room]:
                del open_at[room], rooms[at]
            took = min(n, m)
            if m > took:
                put(room, config, m - took)
            put(room - size_k, (*config, k), took)
            n -= took
    out: dict[tuple[int, ...], int] = {}
    for held in open_at.values():
        for config, n in held:
            out[tuple(sorted(config))] = out.get(tuple(sorted(config)), 0) + n
    return out


def configurations(lengths: list[int], counts: list[int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of sequences of each configuration (of lengths) that hold every piece exactly once.

    Pieces of `size` are sequences by themselves.  The rest is the linear program's: its solution is rounded for
    different shares of its value, what is left is packed best-fit decreasing, and the share that takes the fewest
    sequences is used (of equal ones the largest).  A share below one leaves best fit a mix of lengths to fill gaps with.
    """
    order = np.argsort(lengths)
    a, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    part = a < size
    whole = {(int(a[k]),): int(n[k]) for k in np.flatnonzero(~part)}
    a, n = a[part], n[part]
    if not len(a):
        return sorted(whole.items())
    down = a[::-1].copy()
    use = solve(down, n[::-1].copy(), size)
    value, best, least = sum(use.values()), None, -(-int((a * n).sum()) // size)
    for share in (1.0, 0.9, 0.8, 0.7, 0.6, 0.5):
        left = n[::-1].copy()
        taken = rounded(use, down, left, int(np.ceil(share * value)))
        rest = best_fit(a, left[::-1], size)
        total = sum(taken.values()) + sum(rest.values())
        if best is None or total < best[0]:
            best = (total, taken, rest)
        if total == least:
            break
    for held, of in ((best[1], down), (best[2], a)):
        for config, times in held.items():
            key = tuple(sorted(int(of[k]) for k in config))
            whole[key] = whole.get(key, 0) + times
    return sorted(whole.items())


# --------------------------------------------------------------------------- placing the pieces
def slots(configs: list[tuple[tuple[int, ...], int]], size: int) -> tuple[np.ndarray, ...]:
    """Slot table sorted by (length, first rank): key, first rank, first sequence, offset.

    Ranks [first, first + times) of a length go to one slot of `times` consecutive sequences.
    """
    rows, used, sequence = [], {}, 0
    for config, times in configs:
        offset = 0
        for length in config:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else tuple(np.empty(0, np.int64) for _ in range(4))


def ranked(pieces: DataFrame) -> DataFrame:
    """`pieces` with column rank: 0, 1, ... within each length, however many pieces share a length.

    Tasks have numbered their own pieces of each length; counts by (length, task) give each task its first rank.
    """
    sums = pieces.groupBy("length", "task").agg(F.count("*").alias("_n"))
    # numbered in as many groups as there are (length, group of 256 tasks) pairs
    high = F.floor(F.col("task") / 256)
    outer = sums.groupBy("length", high.alias("_high")).agg(F.sum("_n").alias("_m"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.withColumn("_base", F.coalesce(F.sum("_m").over(before.partitionBy("length").orderBy("_high")), F.lit(0))).drop("_m")
    first = sums.withColumn("_high", high).join(outer, ["length", "_high"])
    inner = F.coalesce(F.sum("_n").over(before.partitionBy("length", "_high").orderBy("task")), F.lit(0))
    first = first.select("length", "task", (F.col("_base") + inner).alias("_first"))
    return pieces.join(first, ["length", "task"]).withColumn("rank", F.col("_first") + F.col("own")).drop("_first", "task", "own")


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of `docs` is tokenized whole and ends with id 0; a null or empty text is that one id.  Only longer
    documents are cut.  Repeated rows are packed once for each row (which of two equal rows gets which place is
    open), a null id stays null, an empty table gives an empty result, and other columns are not read.  What
    the driver holds is the histogram (at most `size` lengths), the program's solution (at most 1 + 1 / STEP uses for
    each length) and the slots made from it, whatever the number of documents; the slots are broadcast.
    """
    pieces = stage(cut(docs, tokenizer or default_tokenizer(), size, id_col, text_col), "pieces")
    spark = docs.sparkSession
    hist = pieces.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()
    table = spark.sparkContext.broadcast(slots(configurations([r["length"] for r in hist], [r["n"] for r in hist], size), size))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, rank, sequence, offset = table.value
        key = length << np.int64(44)
        for b in batches:
            at = np.searchsorted(key + rank, (b["length"].to_numpy(np.int64) << np.int64(44)) + b["rank"].to_numpy(np.int64), "right") - 1
            out = b.drop(columns="rank")
            out["sequence_id"] = sequence[at] + b["rank"].to_numpy(np.int64) - rank[at]
            out["offset"] = offset[at]
            yield out.astype({"doc_id": "Int64"})

    return ranked(pieces).mapInPandas(place, PIECES + ", sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
