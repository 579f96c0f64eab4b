"""Substring dedup by sliding sentence spans.

A text is split into sentences (after . ! ? and white space, after the sentence ends of other scripts, and at line ends). From every
sentence a run starts and at every sentence one ends: the fewest consecutive sentences, two at least, with RUN_WORDS words or more. A
sentence of LONG_WORDS words is a run alone. With both directions, every sentence of a repeated passage of two sentences or more and
RUN_WORDS words lies in a run inside that passage. Runs are hashed (128 bits) and met globally: of equal runs the first (smallest id,
then a hash of the row, then position) stays, and every sentence that any other covers goes. Scripts without spaces count two letters
as a word. The occurrences of one run, which may be a large part of all, are dealt over many tasks by their rows.

Defined cases: null counts as empty; texts without a run lose nothing; null ids come last; rows repeated with the same id and text
count as separate documents, of which one stays whole; a run repeated within one text is a repeat as well; an empty table gives
an empty result; extra columns are ignored by ``repeated_spans`` and kept, whatever their names, by ``remove_repeats``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.common import field, join_hot, read, rows_of, salts, scan_texts, stash, tie_of

RUN_WORDS = 12
LONG_WORDS = 20
_SENTENCE = re.compile(r"[^\s][^\n]*?(?:[.!?]+(?=\s)|(?=\n)|\Z)")
_OTHER_END = re.compile("[。｡！？।॥؟۔።။។]")
#: As _SENTENCE, for texts with an end that needs no white space after it.
_OTHER_SENTENCE = re.compile(r"[^\s][^\n]*?(?:[.!?]+(?=\s)|[。｡！？।॥؟۔።။។]+[」』）”’]*|(?=\n)|\Z)")
#: Thai, Lao, Burmese, Khmer, kana and Han.
_NO_SPACES = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence, without white space at either side."""
    other = not text.isascii() and _OTHER_END.search(text)
    return [m.span() for m in (_OTHER_SENTENCE if other else _SENTENCE).finditer(text)]


def lengths(text: str, parts: list[str]) -> list[int]:
    """Words of each sentence."""
    if text.isascii() or not _NO_SPACES.search(text):
        return [len(p.split()) for p in parts]
    return [len(p.split()) + len(_NO_SPACES.findall(p)) // 2 for p in parts]


def runs(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, bytes]]]:
    """The sentences, and (first sentence, how many, hash) of each run."""
    at = sentences(text)
    parts = [text[a:b] for a, b in at]
    words = lengths(text, parts)
    upto, short = [0], [0]
    for w in words:
        upto.append(upto[-1] + w)
        short.append(short[-1] + (w < LONG_WORDS))
    picked = {(i, i + 1) for i, w in enumerate(words) if w >= LONG_WORDS}
    j = 0
    for i in range(len(at) - 1):
        j = max(j, i + 2)
        while j <= len(at) and upto[j] - upto[i] < RUN_WORDS:
            j += 1
        if j > len(at):
            break
        picked.add((i, j))
    i = len(at)
    for j in range(len(at), 1, -1):
        i = min(i, j - 2)
        while i >= 0 and upto[j] - upto[i] < RUN_WORDS:
            i -= 1
        if i < 0:
            break
        picked.add((i, j))
    found = []
    for i, j in sorted(picked):
        if j == i + 1 or short[j] > short[i]:  # a run of long sentences alone says no more than they do
            found.append((i, j - i, xxhash.xxh3_128_digest("\n".join(parts[i:j]).encode("utf-8", "surrogatepass"))))
    return at, found


def _spans(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, start, end, n_sentences, keep_doc_id) of the spans to remove from ``rows`` (of ``rows_of``)."""

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {"key": b["key"], "doc_id": b["doc_id"], "tie": b["tie"], "starts": [], "ends": [], "runs": []}
            for t in b["text"]:
                at, found = runs(t or "")
                out["starts"].append([a for a, _ in at])
                out["ends"].append([e for _, e in at])
                out["runs"].append([{"pos": p, "n": n, "h": h} for p, n, h in found])
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    picked = rows.select(F.col("row").alias("key"), field(id_col).alias("doc_id"), tie_of(docs).alias("tie"), field(text_col).cast("string").alias("text"))
    schema = f"key binary, doc_id {kind}, tie bigint, starts array<int>, ends array<int>, runs array<struct<pos:int,n:int,h:binary>>"
    scanned = stash(scan_texts(picked, schema, scan).withColumn("row", F.monotonically_increasing_id()), "runs")
    each = scanned.select("row", "doc_id", "tie", F.explode("runs").alias("r")).select("row", "doc_id", "tie", "r.pos", "r.n", "r.h")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "row", "pos")).alias("first")
    repeated = each.groupBy("h").agg(first, F.count(F.lit(1)).alias("times"), salts("row")).where(F.col("times") > 1)
    extra = join_hot(each.select("row", "pos", "n", "h"), repeated.select("h", "first", "salts"), "h", "row")
    extra = extra.where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
    per_row = extra.groupBy("row").agg(F.collect_list(F.struct("pos", "n", F.col("first.doc_id").alias("keep"))).alias("gone"))
    joined = per_row.join(scanned.select("row", "key", "doc_id", "starts", "ends"), "row")

    def merge(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {k: [] for k in ("key", "doc_id", "start", "end", "n_sentences", "keep_doc_id")}
            for key, doc, gone, starts, ends in zip(b["key"], b["doc_id"], b["gone"], b["starts"], b["ends"], strict=True):
                spans: list[list] = []
                for g in sorted(gone, key=lambda g: (g["pos"], g["n"], g["keep"] is None, g["keep"] or 0)):
                    if spans and g["pos"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], g["pos"] + g["n"])
                    else:
                        spans.append([g["pos"], g["pos"] + g["n"], g["keep"]])
                for a, e, keep in spans:
                    for k, v in zip(out, (key, doc, starts[a], ends[e - 1], e - a, keep), strict=True):
                        out[k].append(v)
            yield out

    return scan_texts(joined, f"key binary, doc_id {kind}, start int, end int, n_sentences int, keep_doc_id {kind}", merge)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span to remove, as long as possible: doc_id, start, end (code points, end exclusive), n_sentences, and
    keep_doc_id, the document in which the span's first run stays."""
    return _spans(rows_of(docs), docs, id_col, text_col).drop("key")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated spans cut out of the texts. Spans meet their rows by place, so ids may be null or repeated: of rows
    of one text one stays whole."""
    rows = rows_of(docs)
    spans = _spans(rows, docs, id_col, text_col).groupBy(F.col("key").alias("row")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    text, cut = F.coalesce(field(text_col), F.lit("")), F.col("cut")
    kept = F.aggregate(
        cut, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"])).alias("out"), x["end"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    joined = rows.join(stash(spans, "cuts").hint("merge"), "row", "left")
    return joined.select(F.col("own").withField(f"`{text_col}`", F.when(cut.isNotNull(), kept).otherwise(field(text_col))).alias("own")).select("own.*")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents"))
