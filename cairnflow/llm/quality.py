"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every whole text is reduced to a few dozen statistics. Cosine features with Gaussian frequencies approximate a Gaussian kernel over
the standardised statistics. Each partition sums its share of the normal equations, by fold; the sums of all partitions give the
ridge solution, and solutions that leave out one fold give the out-of-fold scores on which the isotonic calibration is fitted
(pool-adjacent-violators over a fixed grid of score bins, so its input is bounded whatever the corpus).

Defined cases: a null text counts as empty, and empty texts are scored from their (zero) statistics; rows without a label, with a
null label or with a null id are scored but never learned from; of several labels of one id the largest counts; without any
labelled row every score is 0.5; repeated rows are scored one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.common import held_out, labelled_sample, read, scan_texts, stash

FEATURES = 256
BANDWIDTH = 4.0
RIDGE = 1.0
FOLDS = 4
BINS = 3000
GROUPS = 64
LOW, HIGH = -1.0, 2.0
THRESHOLD = 0.3
#: Byte classes: 0 letter, 1 upper case, 2 digit, 3 white space, 4 sentence punctuation, 5 exclamation and question, 6 bar, 7 symbol, 8 beyond ASCII.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(48, 58))] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[ord("|")] = 6
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 7
_CLASS[[*range(9), *range(14, 32), 127]] = 7
_CLASS[128:] = 8
CLASSES = 9
WINDOW = 256
N_STATS = 30


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; zeros for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * N_STATS
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    kind = _CLASS[raw]
    share = np.bincount(kind, minlength=CLASSES) / len(raw)
    starts = np.arange(0, len(raw), WINDOW)
    lengths = np.minimum(WINDOW, len(raw) - starts)
    peak = []
    for k in (1, 2, 5, 6, 7):
        part = np.add.reduceat(kind == k, starts, dtype=np.int64) / np.maximum(lengths, WINDOW // 2)
        peak += [part.max(), part.min()]
    n = len(words)
    counts = Counter(words)
    again = sum(map(eq, words, words[1:])) / n
    lines = [x for x in text.split("\n") if x.strip()]
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
    top = counts.most_common(1)[0][1]
    stops = text.count(". ") + text.count(".\n") + text.count("! ") + text.count("? ") + 1
    return [
        np.log1p(len(text)), np.log1p(n), lens.mean(), np.log1p(lens.max()), lens.std(),
        *share, *peak, again, len(counts) / n, np.log1p(len(counts)) / np.log1p(n), top / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / stops),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row."""

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "stats": [[float(x) for x in statistics(t or "")] for t in b["text"]]}

    kind = dict(docs.dtypes)[id_col]
    return scan_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), f"doc_id {kind}, stats array<double>", scan)


class Kernel:
    """Standardisation and the random Fourier features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = draw.normal(size=(len(mean), FEATURES)) / BANDWIDTH
        self.b = draw.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES)
        return np.hstack([z * 4, x * 0.3, np.ones((len(x), 1))])


def moments(train: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, standard deviation and count of the training statistics, summed by partition."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, N_STATS))
        for f in frames:
            if len(f):
                x = np.stack(f["stats"].to_numpy())
                total += np.stack([np.full(N_STATS, len(x)), x.sum(0), (x * x).sum(0)])
        yield pd.DataFrame({"j": np.arange(N_STATS), "n": total[0], "s": total[1], "ss": total[2]})

    rows = train.select("stats").mapInPandas(one, "j int, n double, s double, ss double").groupBy("j").agg(F.sum("n"), F.sum("s"), F.sum("ss")).collect()
    if not rows or rows[0][1] == 0:
        return np.zeros(N_STATS), np.ones(N_STATS), 0
    a = np.array([list(r) for r in sorted(rows)])
    mean = a[:, 2] / a[:, 1]
    return mean, np.sqrt(np.maximum(a[:, 3] / a[:, 1] - mean**2, 1e-12)) + 1e-6, int(a[0, 1])


def normal_equations(train: DataFrame, kernel: Kernel) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{fold: (Z'Z, Z'y)}. Partitions emit their sums a row of the matrix at a time; the rows are summed by (fold, row), of GROUPS groups
    of partitions first, so that no task gets one of every partition."""
    width = FEATURES + N_STATS + 1

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for f in frames:
            if len(f):
                z, y, fold = kernel(np.stack(f["stats"].to_numpy())), f["y"].to_numpy(float), f["fold"].to_numpy()
                full = np.hstack([z, y[:, None]])
                for k in np.unique(fold):
                    at = fold == k
                    sums[k] = sums.get(k, 0) + z[at].T @ full[at]
        for k, g in sums.items():
            yield pd.DataFrame({"fold": int(k), "i": np.arange(width), "sums": list(g)})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": rows["fold"][:1], "i": rows["i"][:1], "sums": [np.sum(np.stack(rows["sums"].to_numpy()), axis=0)]})

    out_row = "fold int, i int, sums array<double>"
    parts = train.mapInPandas(one, out_row).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    parts = parts.groupBy("fold", "i", "part").applyInPandas(lambda rows: add(rows), out_row).groupBy("fold", "i").applyInPandas(add, out_row)
    out: dict[int, np.ndarray] = {}
    for r in parts.toLocalIterator():
        out.setdefault(r["fold"], np.zeros((width, width + 1)))[r["i"]] = r["sums"]
    return {k: (g[:, :-1], g[:, -1]) for k, g in out.items()}


def ridge(g: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.linalg.solve(g + RIDGE * np.eye(len(g)), v)


def isotonic(positives: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins; bins without rows take the value interpolated between their neighbours."""
    at = np.flatnonzero(counts)
    blocks: list[list[float]] = []
    for i in at:
        blocks.append([positives[i], counts[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, c, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + c, blocks[-1][2] + n]
    value = np.concatenate([np.full(n, p / c) for p, c, n in blocks])
    return np.interp(np.arange(len(counts)), at, value)


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)


def fold_of(id_col: str) -> F.Column:
    """Fold of a labelled row, by its id, so that the query and the pipeline's stage learn the same."""
    return F.pmod(F.xxhash64(id_col), F.lit(FOLDS)).cast("int")


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> tuple[Kernel, np.ndarray, np.ndarray] | None:
    """Kernel, weights and calibration table from the labelled rows that aren't held out; None without such rows."""
    y = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    return fit_on(stash(stats.join(y, "doc_id").select("stats", "y", fold_of("doc_id").alias("fold")), "train"))


def fit_on(train: DataFrame) -> tuple[Kernel, np.ndarray, np.ndarray] | None:
    """The same from rows of (stats, y, fold)."""
    mean, scale, n = moments(train)
    if not n:
        return None
    kernel = Kernel(mean, scale)
    sums = normal_equations(train, kernel)
    g, v = sum(x[0] for x in sums.values()), sum(x[1] for x in sums.values())
    parts = {k: ridge(g - a, v - b) if len(sums) > 1 else ridge(g, v) for k, (a, b) in sums.items()}

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, BINS))
        for f in frames:
            if len(f):
                z, fold, y = kernel(np.stack(f["stats"].to_numpy())), f["fold"].to_numpy(), f["y"].to_numpy(float)
                raw = np.zeros(len(f))
                for k, w in parts.items():
                    raw[fold == k] = z[fold == k] @ w
                total += np.stack([np.bincount(bin_of(raw), y, BINS), np.bincount(bin_of(raw), minlength=BINS)])
        at = np.flatnonzero(total[1])
        yield pd.DataFrame({"bin": at, "p": total[0][at], "n": total[1][at]})

    table = np.zeros((2, BINS))
    for r in train.mapInPandas(binned, "bin int, p double, n double").groupBy("bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect():
        table[:, r["bin"]] = r["p"], r["n"]
    return kernel, ridge(g, v), isotonic(*table)


def score_of(stats: np.ndarray, model: tuple[Kernel, np.ndarray, np.ndarray]) -> np.ndarray:
    """Scores in [0, 1] of rows of statistics. A thousandth of the score is the raw value, so that ties in the calibrated steps keep
    the order of the regression."""
    kernel, w, steps = model
    raw = np.einsum("ij,j->i", kernel(stats), w)  # row by row, so that a text scores alike in any batch
    return 0.999 * steps[bin_of(raw)] + 0.001 * np.clip((raw - LOW) / (HIGH - LOW), 0, 1)


def score(stats: DataFrame, model: tuple[Kernel, np.ndarray, np.ndarray] | None) -> DataFrame:
    """The rows of ``stats`` with a score in [0, 1]."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.full(len(f), 0.5) if model is None or not len(f) else score_of(np.stack(f["stats"].to_numpy()), model)
            yield f.drop(columns="stats").assign(score=out)

    rest = [(c, t) for c, t in stats.dtypes if c != "stats"]
    return stats.mapInPandas(one, ", ".join(f"`{c}` {t}" for c, t in [*rest, ("score", "double")]))


def good_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their own columns. Learning takes about ``max_rows`` labelled rows at
    most; scores are computed as rows pass, so no text is shuffled. The score is that of ``classify``, so nulls, empty and long texts are
treated alike; without a labelled row all stay; extra columns are kept, whatever their names."""
    picked = labelled_sample(docs, labels, "quality", max_rows)
    if picked is None:
        return docs
    marked = picked.select(F.struct("doc_id", "y", fold_of("doc_id").alias("fold")).alias("doc_id"), "text")
    train = document_statistics(marked.withColumn("doc_id", F.to_json("doc_id")))
    train = train.select("stats", F.from_json("doc_id", "y double, fold int").alias("x")).select("stats", "x.y", "x.fold")
    model = fit_on(stash(train, "train"))
    if model is None:
        return docs

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(score_of(np.array([statistics(t or "") for t in texts]).reshape(-1, N_STATS), model))

    return docs.where(quality(F.col("text")) >= threshold)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    stats = stash(document_statistics(docs), "stats")
    out = score(stats, fit(stats, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
