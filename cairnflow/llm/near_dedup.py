"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A text is the weighted set of its shingles of five words (all its words, where it has fewer), weighted by term frequency times
ln(1 + documents / document frequency), which stops growing below COMMON of the documents. Document frequencies are counted over all documents in a table of 2^20 hash buckets: its
size doesn't depend on the corpus, and as both its noise and the documents grow in proportion, weights mean the same at any size.
Improved consistent weighted sampling draws SAMPLES (shingle, level) pairs for each text; two texts draw the same pair with a
probability that is their weighted Jaccard similarity. ROWS pairs make a band, and texts that share a band are compared: a weighted
Jaccard similarity of 0.8 or more is a link, and so is a plain one (a large group of near copies makes its own shingles common, so
that the few that its members don't share would outweigh them). A class is a connected component of links.

Equal texts are one node. In a band bucket of up to PAIRED texts all pairs are compared. In a larger one all texts are compared with
one pivot; then those that still lie outside the pivot's class are compared, in blocks, with those inside and with each other. So no
candidate is left out, yet no list of all pairs is made, and a group of thousands of copies costs little more than a comparison each.

Hot keys: rows that meet facts about their digest, band bucket or class are dealt by key and salt (``join_hot``), a pivot's text goes
to a task for every PIVOT_PAIRS of its partners, and texts are met by their place in the files, which no two rows share.

Defined cases: null counts as empty; a text without words is only alike to texts equal to it; a null id is kept, and is not below
any other; rows repeated with the same id and text are one class, of which one row stays; an empty table gives an empty result;
extra columns are ignored by ``near_duplicates`` and kept, whatever their names, by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.common import field, join_hot, keep_rows, read, rows_of, salts, scan_texts, stash, tie_of
from cairnflow.operators.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
DF_BITS, DF_CHUNKS = 20, 64
#: Share of the documents up to which a shingle counts as rare.
COMMON = 0.05
PAIRED = 6
#: Texts on either side of a comparison of blocks.
BLOCK = 256
#: Partners of a pivot for which its text is sent once.
PIVOT_PAIRS = 1024
#: Partitions whose document frequencies are summed together first.
DF_GROUPS = 256
CACHE_WORDS, CACHED_LENGTH = 200_000, 40
_TABLE = 16
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class Hashes(dict):
    """64-bit hash of each word, kept for a task, as Python workers live on into stages that don't need them. The frequent words
    come early; what comes when CACHE_WORDS are kept isn't kept, nor are words of more than CACHED_LENGTH letters (whole lines, in
    scripts without spaces)."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < CACHE_WORDS and len(word) <= CACHED_LENGTH:
            self[word] = value
        return value


_hashes = Hashes()


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text and how often each occurs."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=n)
    k = min(SHINGLE, n)
    s = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        s = (s ^ h[i : n - k + 1 + i]) * _P[i]
        s ^= s >> np.uint64(31)
    return np.unique(s, return_counts=True)


def buckets(s: np.ndarray) -> np.ndarray:
    return ((s * _P[1]) >> np.uint64(64 - DF_BITS)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents in each hash bucket, documents) of rows of (text). Partitions count apart; the counts are summed by chunk of the
    table, of DF_GROUPS groups of partitions first, so that no task gets one of every partition."""
    width = (1 << DF_BITS) // DF_CHUNKS

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        total, n = np.zeros(1 << DF_BITS, dtype=np.int64), 0
        for b in batches:
            found = [buckets(shingles(t or "")[0]) for t in b["text"]]
            n += len(found)
            total += np.bincount(np.concatenate([np.unique(x) for x in found] or [np.zeros(0, dtype=np.int64)]), minlength=1 << DF_BITS)
        _hashes.clear()
        yield {"chunk": [*range(DF_CHUNKS), -1], "counts": [*(x.tobytes() for x in total.reshape(DF_CHUNKS, width)), np.array([n]).tobytes()]}

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for x in rows["counts"]:
            total = total + np.frombuffer(x, dtype=np.int64)
        return pd.DataFrame({"chunk": rows["chunk"][:1], "counts": [total.tobytes()]})

    out = "chunk int, counts binary"
    parts = scan_texts(texts.select("text"), out, count).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(DF_GROUPS)))
    some = parts.groupBy("chunk", "part").applyInPandas(lambda rows: add(rows), out)
    table, n = np.zeros((DF_CHUNKS, width), dtype=np.int64), 0
    for r in some.groupBy("chunk").applyInPandas(add, out).collect():  # DF_CHUNKS + 1 rows
        got = np.frombuffer(r["counts"], dtype=np.int64)
        if r["chunk"] < 0:
            n = int(got[0])
        else:
            table[r["chunk"]] = got
    return table.ravel(), n


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p(np.minimum(n / np.maximum(df, 1), 1 / COMMON)).astype(np.float32)


def weights_of(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, tf = shingles(text)
    return s, tf * idf[buckets(s)]


class Sampler:
    """Consistent samples. A shingle's random draws (r, c, beta) for sample i are read from tables of draws, each at a place of its own
    that mixes the shingle's hash with the sample's multiplier: 48 bits in all, so that long texts don't share draws."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        n = 1 << _TABLE
        self.r = draw.gamma(2.0, 1.0, n).astype(np.float32)
        self.log_c = np.log(draw.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = draw.random(n).astype(np.float32)
        self.mult = (draw.integers(1, 1 << 62, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def bands(self, s: np.ndarray, w: np.ndarray, block: int = 8192) -> list[int]:
        """The band keys of a weighted set."""
        with np.errstate(over="ignore"):  # hashes wrap around
            return self._bands(s, w, block)

    def _bands(self, s: np.ndarray, w: np.ndarray, block: int) -> list[int]:
        best, key = np.full(SAMPLES, np.inf, dtype=np.float32), np.zeros(SAMPLES, dtype=np.uint64)
        every = np.arange(SAMPLES)
        for at in range(0, len(s), block):
            h, log_w = s[at : at + block], np.log(w[at : at + block]).astype(np.float32)
            mixed = self.mult[:, None] * h[None, :]
            mixed ^= mixed >> np.uint64(32)
            i = mixed.view(np.uint16).reshape(*mixed.shape, 4)  # three of the four 16-bit places
            r, beta = self.r[i[..., 1]], self.beta[i[..., 0]]
            t = np.floor(log_w[None, :] / r + beta)
            a = self.log_c[i[..., 2]] - r * (t - beta + 1)
            j = a.argmin(axis=1)
            now = a[every, j]
            new = now < best
            best[new] = now[new]
            level = t[every, j].astype(np.int64).astype(np.uint64)
            key[new] = ((h[j] * _P[2]) ^ (level * _P[3]))[new]
        out = []
        for b in range(BANDS):
            k = np.uint64(b + 1) * _P[4]
            for x in key[b * ROWS : (b + 1) * ROWS]:
                k = (k ^ x) * _P[0]
                k ^= k >> np.uint64(29)
            out.append(int(k.astype(np.int64)))
        return out


def signatures(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, tie, key, digest, bands) of rows of (doc_id, tie, key, text); bands are empty without words."""

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        sampler = Sampler()
        for b in batches:
            out = []
            for t in b.pop("text"):
                s, w = weights_of(t or "", idf)
                out.append(sampler.bands(s, w) if len(s) else [])
            yield b | {"bands": out}
        _hashes.clear()

    kind = rows.schema["doc_id"].dataType.simpleString()
    picked = rows.select("doc_id", "tie", "key", digest_of(F.col("text")).alias("digest"), "text")
    return scan_texts(picked, f"doc_id {kind}, tie bigint, key binary, digest binary, bands array<bigint>", scan)


def digest_of(text: F.Column) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the weighted and the plain Jaccard similarity of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(max(low / (a[1].sum() + b[1].sum() - low), len(i) / (len(a[0]) + len(b[0]) - len(i))))


def verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity is ``threshold`` or more, of rows (a, b, salts): a's text goes to each of its ``salts`` parts of
    the partners, so that no task gets all partners of one text."""

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        last: tuple = (None, None)
        for x in batches:
            keep = []
            for a, ta, tb in zip(x["a"], x["text_a"], x["text_b"], strict=True):
                if last[0] != a:
                    last = (a, weights_of(ta, idf))
                keep.append(jaccard(last[1], weights_of(tb, idf)))
            yield {"a": x["a"], "b": x["b"], "similarity": keep}
        _hashes.clear()

    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b", F.lit(5)), "salts"))
    left = pairs.select("a", "salts", "salt").distinct().join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, ["a", "salts", "salt"]).select("a", "b", "text_a", "text_b")
    return scan_texts(both, "a bigint, b bigint, similarity double", scan, 200).where(F.col("similarity") >= threshold)


class Joined(dict):
    """Which classes a task's links have joined: each class leads to another of its group, the first of them to itself."""

    def root(self, c: int) -> int:
        while (up := self.setdefault(c, c)) != c:
            self[c] = c = self[up]
        return c

    def join(self, a: int, b: int) -> bool:
        """Join two classes; False if they were."""
        a, b = self.root(a), self.root(b)
        self[b] = a
        return a != b


def compare_blocks(tasks: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(a, b): links between texts of different classes. ``tasks`` has rows (key, l, kind, o, left, node, class, text); in a task each
    left text meets each right one. A text's shares with all right texts come from one pass over their shingles. A link is
    returned if it joins classes that the task's links before it don't: texts that are all alike give a link each, not one a pair."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"a": [], "b": []}
        joined = Joined()
        left, right = f[f["left"]].drop_duplicates("node"), f[~f["left"]].drop_duplicates("node")
        if len(left) and len(right):
            sets = [weights_of(t, idf) for t in right["text"]]
            every, at = np.unique(np.concatenate([x[0] for x in sets]), return_inverse=True)
            w, starts = np.concatenate([x[1] for x in sets]), np.cumsum([0] + [len(x[0]) for x in sets])[:-1]
            totals, sizes = np.array([x[1].sum() for x in sets]), np.array([len(x[0]) for x in sets])
            nodes, classes = right["node"].to_numpy(), right["class"].to_numpy()
            mine = np.zeros(len(every))
            for node, own, text in zip(left["node"], left["class"], left["text"], strict=True):
                s, sw = weights_of(text, idf)
                i = np.minimum(np.searchsorted(every, s), len(every) - 1)
                hit = every[i] == s
                mine[i[hit]] = sw[hit]
                low = np.add.reduceat(np.minimum(mine[at], w), starts)
                n = np.add.reduceat((mine > 0)[at].astype(np.int64), starts)
                mine[i[hit]] = 0
                like = np.maximum(low / (totals + sw.sum() - low), n / (sizes + len(s) - n))
                for j in np.flatnonzero((like >= threshold) & (classes != own)):
                    if joined.join(own, classes[j]):
                        out["a"].append(node)
                        out["b"].append(nodes[j])
        _hashes.clear()
        return pd.DataFrame(out, dtype=np.int64)

    return tasks.groupBy("key", "l", "kind", "o").applyInPandas(one, "a bigint, b bigint")


def block_tasks(rest: DataFrame) -> DataFrame:
    """Rows (key, l, kind, o, left, node, class) of the tasks that compare, in each bucket, the texts outside the pivot's class with
    those inside (kind 0) and with each other (kind 1), BLOCK texts a side. ``rest`` has (key, node, class, pivot, pivot_class)."""
    out = F.col("class") != F.col("pivot_class")
    sizes = rest.groupBy("key").agg(F.count_if(out).alias("n_out"), F.count_if(~out & (F.col("node") != F.col("pivot"))).alias("n_in"), salts("node")).where("n_out > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK)
    rows = join_hot(rest.where(F.col("node") != F.col("pivot")), sizes.select("key", "salts", blocks("n_out").alias("outs"), blocks("n_in").alias("ins")), "key", "node")
    at = F.xxhash64("node", F.lit(7))
    upto = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("chunk", F.when(out, F.pmod(at, "outs")).otherwise(F.pmod(at, F.greatest("ins", F.lit(1)))))
    task = lambda l, kind, o, left: F.struct(l.alias("l"), F.lit(kind).alias("kind"), o.alias("o"), F.lit(left).alias("left"))
    chunk = F.col("chunk")
    of_in = F.transform(upto(zero, F.col("outs") - 1), lambda l: task(l, 0, chunk, False))
    of_out = F.concat(
        F.transform(upto(zero, F.col("ins") - 1), lambda o: task(chunk, 0, o, True)),
        F.transform(upto(chunk, F.col("outs") - 1), lambda o: task(chunk, 1, o, True)),
        F.transform(upto(zero, chunk), lambda l: task(l, 1, chunk, False)),
    )
    return rows.select("key", "node", "class", F.explode(F.when(out, of_out).otherwise(of_in)).alias("t")).select("key", "t.*", "node", "class")


def links(members: DataFrame, texts_of, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links (a, b) among ``members`` (key, node) that make the same classes as all links do. ``texts_of`` gives (node, text) of the
    nodes that it is asked for; it is asked once."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot"), salts("node")).where(F.col("n") > 1)
    sized = stash(join_hot(members, sizes, "key", "node"), "sized")
    texts = texts_of(sized.select("node"))
    few, many = sized.where(F.col("n") <= PAIRED), sized.where(F.col("n") > PAIRED)
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b", F.lit(1).alias("n"))
    pairs = pairs.unionByName(many.where(F.col("node") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b"), "n"))
    pairs = pairs.groupBy("a", "b").agg(F.ceil(F.max("n") / PIVOT_PAIRS).alias("salts"))
    found = stash(verify(stash(pairs, "pairs"), texts, idf, threshold).select("a", "b"), "links")
    classes = connected_components(found, "a", "b").withColumnRenamed("component", "class")
    rest = stash(many.join(classes, "node", "left").select("key", "node", F.coalesce("class", "node").alias("class"), "pivot"), "rest")
    of_pivot = rest.groupBy("key").agg(F.max(F.when(F.col("node") == F.col("pivot"), F.col("class"))).alias("pivot_class"), salts("node"))
    tasks = stash(block_tasks(stash(join_hot(rest, of_pivot, "key", "node"), "rest")), "tasks")
    if not tasks.take(1):
        return found
    return found.unionByName(stash(compare_blocks(tasks.join(texts, "node"), idf, threshold), "links"))


def _classes(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(key, doc_id, class_id, class_size, kept) of ``rows`` (of ``rows_of``)."""
    texts = rows.select(field(id_col).alias("doc_id"), tie_of(docs).alias("tie"), F.col("row").alias("key"), F.coalesce(field(text_col).cast("string"), F.lit("")).alias("text"))
    idf = inverse_frequencies(*document_frequencies(texts))
    signed = stash(signatures(texts, idf).withColumn("row", F.monotonically_increasing_id()), "signatures")
    nodes = signed.groupBy("digest").agg(F.min(F.struct("row", "key", "bands")).alias("x"), salts("row"))
    nodes = stash(nodes.select("digest", "salts", F.col("x.row").alias("node"), F.col("x.key").alias("key"), F.col("x.bands").alias("bands")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        needed = stash(wanted.distinct().join(nodes.select("node", "key"), "node"), "needed")
        return stash(texts.select("key", "text").join(needed.hint("merge"), "key").select("node", "text"), "texts")  # one plan for all sizes

    classes = connected_components(links(members, texts_of, idf, threshold), "a", "b")
    labelled = nodes.join(classes, "node", "left").select("digest", "salts", F.coalesce("component", "node").alias("class"))
    labelled = stash(join_hot(signed.select("row", "key", "doc_id", "tie", "digest"), labelled, "digest", "row"), "classes")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "row")).alias("low")
    sizes = labelled.groupBy("class").agg(low, F.count(F.lit(1)).alias("class_size"), salts("row"))
    return join_hot(labelled, sizes, "class", "row").select("key", "doc_id", F.col("low.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("low.row")).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), class_size and kept (one document of each class, that of
    the smallest id; of repeated rows that of the smallest hash of all columns)."""
    return _classes(rows_of(docs), docs, id_col, text_col, threshold).drop("key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, one of each class, with their own columns."""
    rows = rows_of(docs)
    seen = _classes(rows, docs, id_col, text_col, threshold)
    return keep_rows(rows, stash(seen.where(~F.col("kept")).select(F.col("key").alias("row")), "dropped"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
