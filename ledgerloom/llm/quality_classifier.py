"""Quality classifier by compression: texts are scored by which of two zstandard dictionaries serves them better."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, texts_to_python

#: Labelled rows of each class that the fit may use at most: half build dictionaries, half calibrate.
TRAIN_ROWS = 3000
#: Labelled texts longer than this are not used for the fit (every text is scored, whole).
TRAIN_CHARS = 50_000
DICT_BYTES = 112 * 1024
#: Texts are compressed in blocks, so that a dictionary matters as much at the end of a long text as at its start.
BLOCK = 256
LEVEL = 9


class Model:
    """Two dictionaries and the calibration of their difference."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        self.good, self.bad, self.level, self.weights, self._made = good, bad, level, (0.0, 0.0), None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def sizes(self, text: str | None) -> tuple[int, int, int]:
        """Bytes of the text, and of its blocks compressed with the good and with the bad dictionary."""
        if self._made is None:
            held = [zstandard.ZstdCompressionDict(d, zstandard.DICT_TYPE_RAWCONTENT) for d in (self.good, self.bad)]
            for d in held:
                d.precompute_compress(level=self.level)
            self._made = [zstandard.ZstdCompressor(level=self.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False) for d in held]
        raw = (text or "").encode("utf-8", "replace")
        g = b = 0
        for k in range(0, len(raw), BLOCK):
            part = raw[k : k + BLOCK]
            g += len(self._made[0].compress(part))
            b += len(self._made[1].compress(part))
        return len(raw), g, b

    def difference(self, text: str | None) -> float:
        """(bad - good) / bytes of the text: above 0 when the good dictionary compresses better; 0 for an empty text."""
        n, g, b = self.sizes(text)
        return (b - g) / n if n else 0.0

    def score(self, text: str | None) -> float:
        a, c = self.weights
        return float(1 / (1 + np.exp(-np.clip(a * self.difference(text) + c, -30, 30))))


def dictionary(fragments: list[str], size: int) -> bytes:
    """Raw dictionary content: the fragments, one after another."""
    return b"\n".join(f.encode("utf-8", "replace") for f in fragments)[:size] or b" " * 16


def calibrate(x: np.ndarray, y: np.ndarray, share: float = 0.5, rounds: int = 200) -> tuple[float, float]:
    """Platt's logistic of the difference by Newton steps with a small ridge; `share` is class 1's share of all labels."""
    if len(set(y.tolist())) < 2:
        return 0.0, 2.0 if len(y) and y[0] else (-2.0 if len(y) else 0.0)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    w = np.where(y == 1, share / n1, (1 - share) / n0)
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    f, theta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ theta, -30, 30)))
        grad = f.T @ (w * (p - t)) + np.array([1e-7, 1e-7]) * theta
        hess = (f * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ f + 1e-7 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Fit on at most `rows` labelled texts of each class (of at most `chars` characters), picked by a hash of doc_id.

    `labels` has doc_id and quality (1 good, 0 bad, null ignored); which rows it holds is the caller's choice.  The
    sample is bounded by rows * chars characters whatever the input's size, and stays in the shared folder: the
    driver gets ids, a fragment of about DICT_BYTES / rows characters of every other text for the dictionaries, and
    the size differences of the rest, measured in tasks, for the calibration.  Texts that repeat an id and a text
    count once; null and empty texts are not used; without labels of both classes every score is one constant.
    """
    counts = {r["quality"]: r["n"] for r in labels.filter("quality in (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    own = labels.filter("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("quality").alias("cls")).distinct()
    # bounded first: ids only, so that texts of at most 2 * rows documents of each class are read
    ids = [own.filter(F.col("cls") == c).orderBy(F.xxhash64("_id"), "_id").limit(2 * rows) for c in (1, 0)]
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).filter((F.length("text") <= chars) & (F.length("text") > 0))
    held = stage(texts.join(F.broadcast(ids[0].unionByName(ids[1])), "_id").withColumn("tag", F.xxhash64("text")), "labelled")
    keys = sorted({(r["cls"], r["h"], r["_id"], r["tag"]) for r in held.select("cls", F.xxhash64("_id").alias("h"), "_id", "tag").toLocalIterator()})
    chosen = [(c, i, tag, n) for c in (0, 1) for n, (_, _, i, tag) in enumerate([k for k in keys if k[0] == c][:rows])]
    spark = docs.sparkSession
    picked = spark.createDataFrame(chosen, f"cls int, _id {held.schema['_id'].dataType.simpleString()}, tag long, n int")
    used = held.dropDuplicates(["cls", "_id", "tag"]).join(F.broadcast(picked), ["cls", "_id", "tag"])
    parts = []
    for c in (1, 0):
        each = max(128, DICT_BYTES // max(1, sum(k[0] == c and k[3] % 2 == 0 for k in chosen)))
        middle = F.greatest(F.lit(1), F.floor((F.length("text") - each) / 2).cast("int") + 1)
        got = used.filter((F.col("cls") == c) & (F.col("n") % 2 == 0)).select("n", F.substring("text", middle, F.lit(each)).alias("fragment")).collect()
        parts.append(dictionary([r["fragment"] for r in sorted(got)], DICT_BYTES))
    model = Model(*parts)
    shared = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cls": b["cls"], "x": [shared.value.difference(t) for t in b["text"]]})

    rest = texts_to_python(used).filter("n % 2 = 1").select("cls", "text").mapInPandas(measured, "cls int, x double").collect()
    x, y = np.array([r["x"] for r in rest]), np.array([r["cls"] for r in rest])
    model.weights = calibrate(x, y, min(max(counts.get(1, 0) / max(sum(counts.values()), 1), 0.05), 0.95))
    return model


SCORED = "doc_id long, score double, predicted int"


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, score in [0, 1] of its whole text, predicted 1 when score >= 0.5.

    Only the text is an input of the score.  A null text is empty; an empty text gets the calibration's
    intercept.  Repeated rows give repeated results, null ids stay null, an empty table gives an empty result,
    and other columns are not read.  The model (two dictionaries of at most 112 KiB) is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            score = np.array([m.score(t) for t in b["text"]], float)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "score": score, "predicted": (score >= 0.5).astype("int32")})

    return texts_to_python(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInPandas(run, SCORED)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose whole text scores 0.5 or more, with all their columns.

    Each row is judged by its own text: repeated rows stay or go together, a null text counts as an empty one (which
    gets the calibration's intercept), ids play no part, an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        return text.map(lambda t: held.value.score(t) >= 0.5).astype(bool)

    return texts_to_python(docs).filter(good(docs[text_col].cast("string")))


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows of `labels` that may be learned from."""
    return labels.filter("doc_id is not null").filter(~is_held_out()).select("doc_id", "quality")


def op7_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = classify(docs, fit(docs, training_labels(labels)))
    return out.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
