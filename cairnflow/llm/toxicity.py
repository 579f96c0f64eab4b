"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its lower-cased words, word pairs, pairs with one word left out, and word beginnings of a few lengths,
each hashed to one of 2^20 coordinates. Learning is FTRL-proximal: a rate of its own for each coordinate, and L1, which leaves few non-zero weights;
these are small enough to broadcast. Learning takes a sample of the labelled rows of at most about ``MAX_ROWS`` rows (all, where
there are fewer), in ``SHARDS`` shards whose weights are averaged; scoring covers every row and every whole text.

Defined cases: a null text counts as empty, and an empty text is scored from the intercept; rows without a label, with a null label
or with a null id are scored but never learned from; of several labels of one id the largest counts; without any labelled row
every score is 0.5; repeated rows are scored one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.common import held_out, labelled_sample, read, scan_texts

BITS = 20
#: Bound of the rows that are learned from.
MAX_ROWS = 40_000
SHARDS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 6.0, 0.1
THRESHOLD = 0.5
#: Weight of a positive row in the loss; positives are few.
POSITIVE = 3.0
#: Lengths of word beginnings that count as words of their own, so that inflected forms share a coordinate.
STEMS = (4, 5, 6, 7, 8)
CACHED_LENGTH = 40
_WORD = re.compile(r"\w+")


class Hashes(dict):
    """Hashes of each word and of its beginnings, as bytes; forgotten when there are more than half a million words. Words of more than
    CACHED_LENGTH letters (whole lines, in scripts without spaces) aren't kept."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 500_000:
            self.clear()
        units = [word] + [f"{k} {word[:k]}" if len(word) >= k else word for k in STEMS]
        value = b"".join(xxhash.xxh64_digest(u.encode("utf-8", "surrogatepass")) for u in units)
        if len(word) <= CACHED_LENGTH:
            self[word] = value
        return value


_hashes = Hashes()
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_mark = np.zeros(1 << BITS, dtype=np.int32)


def coordinates(text: str) -> np.ndarray:
    """The distinct coordinates of a text; the first is 0, the intercept."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(1, dtype=np.int64)
    units = np.frombuffer(b"".join(map(_hashes.__getitem__, words)), dtype=np.uint64).reshape(len(words), -1)
    h = units[:, 0]
    g = np.concatenate([units.ravel(), (h[:-1] * _A) ^ (h[1:] + _B), (h[:-2] * _B) ^ (h[2:] + _A)])
    g = ((g * _A) >> np.uint64(64 - BITS)).astype(np.int64)
    g = np.concatenate([np.zeros(1, dtype=np.int64), g[g > 0]])
    place = np.arange(len(g), dtype=np.int32)
    _mark[g] = place
    return g[_mark[g] == place]


def ftrl(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """Weights after ``epochs`` passes in a fixed random order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    order = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i = rows[r]
            zi, ni = z[i], n[i]
            w = weights(zi, ni, L1)
            w[0] = weights(zi[:1], ni[:1], 0.0)[0]
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[r]) * (POSITIVE if y[r] else 1.0)
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i] = zi + g - sigma * w
            n[i] = ni + g * g
    out = weights(z, n, L1)
    out[0] = weights(z[:1], n[:1], 0.0)[0]
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """(coordinates, weights) that aren't zero; None without labelled rows."""
    picked = labelled_sample(docs, labels, label_col, max_rows)
    if picked is None:
        return None

    def grams(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {
                "shard": [xxhash.xxh64_intdigest(str(i)) % SHARDS for i in b["doc_id"]], "doc_id": [str(i) for i in b["doc_id"]], "y": b["y"],
                "at": [coordinates(t or "").astype(np.int32).tobytes() for t in b["text"]],
            }

    rows = scan_texts(picked, "shard int, doc_id string, y double, at binary", grams)

    def learn(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("doc_id")
        w = ftrl([np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in shard["at"]], shard["y"].to_numpy())
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at] * len(shard), "n": len(shard)})

    parts = rows.groupBy("shard").applyInPandas(learn, "at bigint, w double, n bigint").toPandas()
    if not len(parts):
        return None
    sums = parts.groupby("at")["w"].sum()
    seen = parts.loc[parts["at"] == 0, "n"].sum() or parts["n"].max()
    return sums.index.to_numpy(), sums.to_numpy() / seen


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = fit(docs, labels)

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        w = np.zeros(1 << BITS)
        if model is not None:
            w[model[0]] = model[1]
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": [float(1 / (1 + np.exp(-np.clip(w[coordinates(t or "")].sum(), -35, 35)))) for t in b["text"]]}

    kind = dict(docs.dtypes)["doc_id"]
    out = scan_texts(docs.select("doc_id", "text"), f"doc_id {kind}, score double", scan)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
