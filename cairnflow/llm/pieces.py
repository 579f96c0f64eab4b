"""SentencePiece encoding and decoding by a lattice of pieces.

A text is cut into words (a run of space marks and what follows). All substrings of a word up to the longest piece's length are
met with the piece table; the pieces found are the edges of the word's lattice, and a fold over the edges gives its ids. For a
unigram model the fold is Viterbi. The public 32k model is a BPE model, whose right ids are not a best path: its fold replays the merges,
each time joining the two neighbouring parts whose union is the edge of the best score (ties to the left). Characters without a
piece become byte pieces. Decoding meets the ids with the piece table and joins the pieces.

``encode_words`` is the relational form (explode, equi-join, group, higher-order aggregate) over a table of distinct words.
``encode`` and ``decode`` run the same lattice inside partitions, over the distinct words of each batch: a corpus has tens of
substring rows for each distinct word, and giving every occurrence its ids by a join moves the whole text through a shuffle.

Defined cases: null counts as empty, and has no ids; a space mark in a text is a space after decoding; words of any length are
encoded whole; ids outside the table raise; repeated rows are encoded one by one; an empty table gives an empty result; other
columns are kept unless named like the new ones, which win.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from cairnflow.llm.common import BATCH_ROWS, read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words kept by a Python worker. The frequent ones come early, so what comes when it is full isn't kept.
CACHE_WORDS = 150_000
NONE = -float("inf")
#: Words of more characters than this are folded with a heap.
SHORT = 128


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        elif key & 7 == 5:
            yield key >> 3, struct.unpack("<f", raw[at : at + 4])[0]
            at += 4
        else:
            yield key >> 3, raw[at : at + 8]
            at += 8


@dataclass
class PieceTable:
    """Pieces with score and kind, in the order of their ids; ``bpe`` tells the fold, ``prefix`` whether a text gets a space in front."""

    pieces: list[tuple[str, float, int]]
    bpe: bool = True
    prefix: bool = True

    @classmethod
    def load(cls, path: str = MODEL) -> PieceTable:
        pieces, bpe, prefix, plain = [], False, True, True
        for k, v in _fields(Path(path).read_bytes()):
            if k == 1:
                x = dict(_fields(v))
                pieces.append((x[1].decode(), x.get(2, 0.0), x.get(3, NORMAL)))
            elif k == 2:
                bpe = dict(_fields(v)).get(3, 1) == 2
            elif k == 3:
                x = dict(_fields(v))
                prefix, plain = bool(x.get(3, 1)), x.get(1, b"") == b"identity" and not x.get(4, 1)
        if not plain:
            raise ValueError("only models without normalisation are supported")
        return cls(pieces, bpe, prefix)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}

    @cached_property
    def scores(self) -> dict[str, float]:
        return {p: self.pieces[i][1] for p, i in self.ids.items()}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    @cached_property
    def bytes_at(self) -> list[int]:
        at = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        return [at.get(b, unknown) for b in range(256)]

    @cached_property
    def pairs(self) -> set[str]:
        """Every pair of characters that stands in a piece. Between two characters that are no such pair, a word can be cut."""
        return {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    @cached_property
    def spelled(self) -> list[bytes]:
        """What each id decodes to."""
        return [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, kind in self.pieces
        ]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score) of the pieces that text can match."""
        return spark.createDataFrame([(p, i, float(self.pieces[i][1])) for p, i in self.ids.items()], "piece string, id int, score double")


class Lattice:
    """Ids of words by their lattice, with the first words seen kept."""

    def __init__(self, table: PieceTable):
        self.table, self.words, self.parts = table, {}, {}

    def edges(self, word: str) -> dict[tuple[int, int], tuple[float, int]]:
        """{(start, end): (score, id)} of every substring that is a piece."""
        ids, pieces, most, n = self.table.ids, self.table.pieces, self.table.longest, len(word)
        return {
            (i, j): (pieces[k][1], k) for i in range(n) for j in range(i + 1, min(n, i + most) + 1) if (k := ids.get(word[i:j])) is not None
        }

    def spell(self, word: str, bounds: list[int]) -> list[int]:
        ids, out = self.table.ids, []
        for a, b in zip(bounds, bounds[1:], strict=False):
            k = ids.get(word[a:b])
            if k is not None:
                out.append(k)
            else:
                out += [self.table.bytes_at[x] for x in word[a:b].encode()]
        return out

    def merged(self, word: str) -> list[int]:
        """Boundaries after all merges of a short word. Only the edges that join two neighbouring parts are met."""
        score, bounds = self.table.scores.get, list(range(len(word) + 1))
        joins = [score(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while joins and (best := max(joins)) > NONE:
            k = joins.index(best)
            del bounds[k + 1], joins[k]
            if k < len(joins):
                joins[k] = score(word[bounds[k] : bounds[k + 2]], NONE)
            if k:
                joins[k - 1] = score(word[bounds[k - 1] : bounds[k + 1]], NONE)
        return bounds

    def merged_long(self, word: str) -> list[int]:
        """The same with a heap of candidate merges."""
        score, most, n = self.table.scores.get, self.table.longest, len(word)
        right, left = list(range(1, n + 2)), list(range(-1, n + 1))
        heap = [(-x, i, i + 1, i + 2) for i in range(n - 1) if (x := score(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * (n + 1)
        while heap:
            _, a, m, b = heapq.heappop(heap)
            if not (alive[a] and alive[m] and alive[b]) or right[a] != m or right[m] != b:
                continue
            alive[m] = False
            right[a], left[b] = b, a
            if b < n and (c := right[b]) - a <= most and (x := score(word[a:c])) is not None:
                heapq.heappush(heap, (-x, a, b, c))
            if a > 0 and b - (z := left[a]) <= most and (x := score(word[z:b])) is not None:
                heapq.heappush(heap, (-x, z, a, b))
        return [i for i in range(n + 1) if alive[i]]

    def viterbi(self, word: str) -> list[int]:
        """Boundaries of the path of the largest sum of scores; characters without a piece cost the lowest score less ten."""
        low = min((s for _, s, kind in self.table.pieces if kind == NORMAL), default=0.0) - 10
        edges = self.edges(word)
        best, back, by_end = [0.0] + [-float("inf")] * len(word), [0] * (len(word) + 1), {}
        for (i, j), (s, _) in edges.items():
            by_end.setdefault(j, []).append((i, s))
        for j in range(1, len(word) + 1):
            for i, s in sorted(by_end.get(j, [])):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, i
            if (j - 1, j) not in edges and best[j - 1] + low > best[j]:
                best[j], back[j] = best[j - 1] + low, j - 1
        bounds = [len(word)]
        while bounds[-1]:
            bounds.append(back[bounds[-1]])
        return bounds[::-1]

    def part(self, part: str) -> list[int]:
        """Ids of a stretch that no piece leaves."""
        found = self.parts.get(part)
        if found is None:
            fold = self.viterbi if not self.table.bpe else self.merged if len(part) <= SHORT else self.merged_long
            found = self.spell(part, fold(part))
            if len(part) <= SHORT and len(self.parts) < CACHE_WORDS:
                self.parts[part] = found
        return found

    def word(self, word: str) -> bytes:
        """Ids of a word, as 32-bit integers."""
        pairs, out, at = self.table.pairs, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in pairs:
                out += self.part(word[at:i])
                at = i
        out += self.part(word[at:])
        return np.array(out, dtype=np.int32).tobytes()

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        marked = text.replace(" ", SPACE)
        units = _UNIT.findall(SPACE + marked if self.table.prefix else marked)
        known, here = self.words, {}
        for u in set(units):
            ids = known.get(u)
            if ids is None:
                ids = self.word(u)
                if len(u) <= SHORT and len(known) < CACHE_WORDS:
                    known[u] = ids
            here[u] = ids
        return b"".join(map(here.__getitem__, units))


def spell_out(ids: list[int], table: PieceTable) -> str:
    text = b"".join(map(table.spelled.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if table.prefix and text.startswith(" ") else text


_lattices: dict = {}


def _lattice(table: PieceTable, tag: str) -> Lattice:
    """One lattice for each Python worker, which keeps its words from task to task."""
    if tag not in _lattices:
        _lattices.clear()
        _lattices[tag] = Lattice(table)
    return _lattices[tag]


def encode(docs: DataFrame, table: PieceTable, text_col: str = "text", check: bool = True) -> DataFrame:
    """``docs`` without its text, with n_tokens, ids and, if ``check``, round_trip: whether the ids decode to the text."""
    own = [c for c in docs.columns if c.lower() not in (text_col.lower(), "n_tokens", "ids", "round_trip")]
    tag = f"{len(table.pieces)}-{hash((tuple(table.pieces), table.bpe, table.prefix))}"
    packed = docs.select(F.struct(F.lit(0).alias("at"), *[docs[f"`{c}`"] for c in own]).alias("own"), docs[f"`{text_col}`"].cast("string").alias("text"))
    schema = StructType([docs.schema[c] for c in own]).add("n_tokens", LongType()).add("ids", ArrayType(IntegerType()))
    if check:
        schema = schema.add("round_trip", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(table, tag)
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                rows = b.slice(at, BATCH_ROWS)
                texts = rows.column("text").to_pylist()
                raw = [lattice.text(t or "") for t in texts]
                ends = np.cumsum([0] + [len(x) // 4 for x in raw]).astype(np.int32)
                flat = np.frombuffer(b"".join(raw), dtype=np.int32)
                arrays = rows.column("own").flatten()[1:] + [pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if check:
                    same = [spell_out(np.frombuffer(x, dtype=np.int32).tolist(), lattice.table) == (t or "").replace(SPACE, " ") for x, t in zip(raw, texts, strict=True)]
                    arrays.append(pa.array(same, type=pa.bool_()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return packed.mapInArrow(run, schema)


def decode(encoded: DataFrame, table: PieceTable, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text that its ids spell."""
    own = [c for c in encoded.columns if c != text_col]
    schema = encoded.select(*own).schema.add(text_col, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else spell_out(x, table) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(texts, type=pa.string())], names=schema.names)

    return encoded.select(*own).mapInArrow(run, schema)


def encode_words(words: DataFrame, table: PieceTable, word_col: str = "word") -> DataFrame:
    """(word, ids) of a table of distinct words that hold their space marks, by DataFrame operations alone."""
    spark, n, most = words.sparkSession, F.length("word"), table.longest
    words = words.select(F.col(word_col).alias("word")).where(F.length(word_col) > 0)
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    subs = starts.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), n - F.col("s")))).alias("len"))
    subs = subs.select("word", "s", (F.col("s") + F.col("len")).alias("e"), F.substring("word", F.col("s") + 1, F.col("len")).alias("piece"))
    # The piece table is a model's: its size is fixed.
    hits = subs.join(F.broadcast(table.frame(spark)), "piece").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("e", "s", "score", "id"))).alias("edges"))
    rows = words.join(hits, "word", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<e:int,s:int,score:double,id:int>>")))
    spots = F.sequence(F.lit(0), n)
    if table.bpe:
        def merge(bounds, _):
            inside = lambda e: F.filter(bounds, lambda b: (b >= e["s"]) & (b <= e["e"]))
            fits = F.filter("edges", lambda e: (F.size(inside(e)) == 3) & F.array_contains(bounds, e["s"]) & F.array_contains(bounds, e["e"]))
            best = F.array_max(F.transform(fits, lambda e: F.struct(e["score"].alias("score"), (-e["s"]).alias("left"), e["e"].alias("e"))))
            return F.when(best.isNull(), bounds).otherwise(F.filter(bounds, lambda b: ~((b > -best["left"]) & (b < best["e"]))))

        bounds = F.aggregate(F.sequence(F.lit(1), n), spots, merge)
    else:
        low = min((s for _, s, kind in table.pieces if kind == NORMAL), default=0.0) - 10
        bare = F.filter(F.sequence(F.lit(1), n), lambda j: ~F.exists("edges", lambda e: (e["e"] == j) & (e["s"] == j - 1)))
        rows = rows.withColumn("all", F.array_sort(F.concat("edges", F.transform(bare, lambda j: F.struct(j.alias("e"), (j - 1).alias("s"), F.lit(float(low)).alias("score"), F.lit(-1).alias("id"))))))
        start = F.transform(spots, lambda i: F.struct(F.when(i == 0, 0.0).otherwise(float("-inf")).alias("sum"), F.lit(0).alias("back")))

        def relax(state, e):
            total = F.element_at(state, e["s"] + 1)["sum"] + e["score"]
            return F.transform(state, lambda x, i: F.when((i == e["e"]) & (total > x["sum"]), F.struct(total.alias("sum"), e["s"].alias("back"))).otherwise(x))

        paths = F.aggregate("all", start, relax)
        rows = rows.withColumn("paths", paths)
        walk = lambda path, _: F.when(F.element_at(path, 1) == 0, path).otherwise(F.concat(F.array(F.element_at("paths", F.element_at(path, 1) + 1)["back"]), path))
        bounds = F.aggregate(F.sequence(F.lit(1), n), F.array(n), walk)
    rows = rows.withColumn("bounds", bounds)
    spans = F.transform(F.sequence(F.lit(1), F.size("bounds") - 1), lambda i: F.struct(F.element_at("bounds", i).alias("s"), F.element_at("bounds", i + 1).alias("e")))
    at = F.array(*[F.lit(i) for i in table.bytes_at])

    def spell(x):
        hit = F.filter("edges", lambda e: (e["s"] == x["s"]) & (e["e"] == x["e"]))
        hexed = F.hex(F.encode(F.substring(F.col("word"), x["s"] + 1, x["e"] - x["s"]), "UTF-8"))
        raw = F.transform(F.sequence(F.lit(1), (F.length(hexed) / 2).cast("int")), lambda i: F.element_at(at, F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("int") + 1))
        return F.when(F.size(hit) > 0, F.transform(hit, lambda e: e["id"])).otherwise(raw)

    return rows.select("word", F.flatten(F.transform(spans, spell)).alias("ids"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents").select("doc_id", "text"), PieceTable.load())
