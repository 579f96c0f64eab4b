"""Secret scan with corpus-wide ownership frequency.

Every whole text is searched for three base kinds (assign, access, hex) and for further token shapes. The value of every
candidate is hashed; the hashes are counted over the corpus by distinct repositories and distinct owners. A value that many
owners carry is a copied example; a value that one owner alone carries looks live, and its further-shape spans are added.

Defined cases: a null text counts as empty; documents without a candidate have counts 0, an empty span list and the digest of
the empty string; repeated rows are scanned one by one; null owners and repositories count as one unnamed owner each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.common import join_hot, read, salts, scan_texts, stash

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A match of [0-9a-f]+ is always a maximal run, so runs of 24 and more are the matches that stay.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
#: A private key from its header to its END line or, without one, to the last line of base64 that follows; a header alone counts too.
#: Nothing backtracks, and a body stops at the next five dashes, so a text of headers alone takes linear time.
PEM = re.compile(
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nrt])*+(?:[A-Za-z0-9+/=]{16,}+|(?:Proc-Type|DEK-Info):[^\n\\]*+))*+)"
)
#: Line ends, indents and their escapes: the same key may be laid out in many ways.
_LAYOUT = re.compile(r"\s+|\\[nrt]")
#: Further shapes; a span of theirs is added when its value is owner-specific.
SHAPES = (
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}")),
    ("pem", PEM),
    ("mixed", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9a-z_-]*[A-Z])(?=[0-9A-Z_-]*[a-z])[A-Za-z0-9_-]{32,}")),
)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IS_HEX = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_TOKEN = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_IS_TOKEN = bytes(120 if b in _TOKEN else 32 for b in range(256))
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the base kinds, by start and then as KINDS lists them."""
    raw, found = text.encode("utf-8", "surrogatepass"), []
    low = raw.translate(_LOWER)
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in raw.translate(_IS_HEX):
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e, v) for s, k, e, v in sorted(found)]


def shape_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, value) of the further shapes, by start."""
    found, raw = [], text.encode("utf-8", "surrogatepass")
    long = b"x" * 32 in raw.translate(_IS_TOKEN)
    for k, (kind, shape) in enumerate(SHAPES):
        if {"github": long, "mixed": long, "slack": b"xox" in raw, "jwt": b"eyJ" in raw, "pem": b"-----BEGIN" in raw}[kind]:
            found += [(m.start(), k, m.end(), _LAYOUT.sub("", m[0]) if shape is PEM else m[0]) for m in shape.finditer(text)]
    return [(s, SHAPES[k][0], e, v) for s, k, e, v in sorted(found)]


def joined(spans: list[tuple[int, str, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in spans)


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One row per document: base counts, base spans and their digest, and its candidates with their hashes."""

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "base_sha256", "found")}
            for text in b["text"]:
                base, more = base_spans(text or ""), shape_spans(text or "")
                for k in KINDS:
                    out[f"n_{k}"].append(sum(x[1] == k for x in base))
                out["base"].append(joined(base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["found"].append(
                    [
                        {"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()[:16], "base": n < len(base)}
                        for n, (s, k, e, v) in enumerate(base + more)
                    ]
                )
            yield out | {"doc_id": b["doc_id"], "repo": b["repo"], "owner": b["owner"]}

    picked = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
    )
    kind = dict(docs.dtypes)[id_col]
    return scan_texts(
        picked,
        f"doc_id {kind}, repo string, owner string, n_assign bigint, n_access bigint, n_hex bigint, base string, base_sha256 string, "
        "found array<struct<kind:string,start:bigint,end:bigint,hash:binary,base:boolean>>",
        scan,
    )


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each candidate hash, with the salts of its rows. Both are de-duplicated map-side first, so
    a value that a third of all rows hold is a few rows when it is counted."""
    bits = F.bit_or("salts").alias("salts")
    repos = found.groupBy("hash", "repo").agg(F.count(F.lit(1)).alias("n"), salts("row")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"), F.sum("n").alias("n_seen"), bits)
    owners = found.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "hash")


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source",
    max_live_owners: int = 1, min_example_owners: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(documents, candidates): per document the base digests; per candidate span its ownership counts and verdict.

    verdict: 'live' up to ``max_live_owners`` owners, 'example' from ``min_example_owners`` owners, else 'shared'.
    """
    per_doc = stash(candidates(docs, id_col, text_col, repo_col, owner_col).withColumn("row", F.monotonically_increasing_id()), "secrets")
    rows = per_doc.where(F.size("found") > 0).select("row", "doc_id", "repo", "owner", F.explode("found").alias("f")).select("row", "doc_id", "repo", "owner", "f.*")
    counts = ownership(rows)
    verdict = F.when(F.col("n_owners") <= max_live_owners, "live").when(F.col("n_owners") >= min_example_owners, "example").otherwise("shared")
    return per_doc, join_hot(rows, counts, "hash", "row").withColumn("verdict", verdict)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc, rows = scan_secrets(read(spark, sf_dir, "documents"))
    added = (
        rows.where(~F.col("base") & (F.col("verdict") == "live"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    )
    rank = {k: i for i, k in enumerate([*KINDS, *(k for k, _ in SHAPES)])}
    ranks = F.create_map(*[x for k, i in rank.items() for x in (F.lit(k), F.lit(i))])
    part = lambda x: F.struct(x["start"].alias("start"), ranks[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))
    both = F.concat(
        F.transform(F.filter("found", lambda x: x["base"]), part),
        F.transform(F.coalesce("added", F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>")), part),
    )
    spans = F.array_join(F.transform(F.array_sort(both), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return per_doc.join(added, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))
