"""License scan: exact phrases, and fuzzy search for short notices.

Words are maximal runs of 0-9, a-z (A-Z is lowered first) and non-ASCII characters. Base phrases are places where a phrase's
words stand consecutively. A notice is searched with up to k edits in the words joined by single spaces: it is split into k + 1
parts, so a match with at most k edits holds one part unchanged (pigeonhole). Places of such parts give windows; in these the
regex library's bounded-error matching verifies the edits and reports the span.

Defined cases: a null text counts as empty; a document without a place has count 0, null first and last word, empty labels and
score 0; repeated rows are scanned one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.common import read, scan_texts

PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))
#: (label, normalised notice, edits)
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("mit", "released under the mit license", 3),
    ("apache", "licensed under the apache license version 2 0", 4),
    ("gpl", "licensed under the gnu general public license version 3", 5),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", 7),
    ("lgpl", "under the terms of the gnu lesser general public license", 5),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 7),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", 6),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", 5),
    ("unlicense", "this is free and unencumbered software released into the public domain", 6),
)
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def parts(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """(offset, part): edits + 1 parts of nearly equal length that cover the notice."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def compiled(notices=NOTICES) -> list[tuple]:
    """(label, notice, edits, parts, pattern). Parts under four bytes would fire everywhere, so such notices are refused."""
    out = []
    for label, text, edits in notices:
        notice = text.encode()
        seeds = parts(notice, edits)
        if min(len(x) for _, x in seeds) < 4:
            raise ValueError(f"{edits} edits are too many for the notice {text!r}")
        out.append((label, notice, edits, seeds, regex.compile(b"(?e)(?:" + regex.escape(notice, literal_spaces=True) + b"){e<=%d}" % edits)))
    return out


def fuzzy(joined: bytes, notices: list[tuple]) -> list[tuple[str, int, int, int, int]]:
    """(label, start, end, edits, length of the notice) of every verified place, as offsets into ``joined``."""
    found = []
    for label, notice, edits, seeds, pattern in notices:
        spans = []
        for offset, seed in seeds:
            at = joined.find(seed)
            while at >= 0:
                spans.append((max(0, at - offset - edits), at - offset + len(notice) + edits))
                at = joined.find(seed, at + 1)
        if not spans:
            continue
        spans.sort()
        windows = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], b)
            else:
                windows.append([a, b])
        for a, b in windows:
            for m in pattern.finditer(joined, a, min(b, len(joined))):
                found.append((label, m.start(), m.end(), sum(m.fuzzy_counts), len(notice)))
    return found


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES) -> DataFrame:
    """One row per document with base places, labels, score, and the verified notices as word spans."""

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        ready = compiled(notices)
        for b in batches:
            out: dict = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices")}
            for text in b["text"]:
                words = words_of(text or "")
                joined = b" ".join(words)
                places, base = [], set()
                padded = b" " + joined + b" "
                for phrase, label in PHRASES:
                    at = padded.find(b" " + phrase + b" ")
                    while at >= 0:
                        places.append(padded.count(b" ", 0, at))
                        base.add(label)
                        at = padded.find(b" " + phrase + b" ", at + 1)
                near = fuzzy(joined, ready)
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {x[0] for x in near})))
                out["score"].append(1.0 if places else max((1 - x[3] / x[4] for x in near), default=0.0))
                out["notices"].append(
                    [{"label": x[0], "start_word": joined.count(b" ", 0, x[1]), "end_word": joined.count(b" ", 0, x[2]) + 1, "edits": x[3]} for x in near]
                )
            yield out | {"doc_id": b["doc_id"]}

    kind = dict(docs.dtypes)[id_col]
    return scan_texts(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "notices array<struct<label:string,start_word:bigint,end_word:bigint,edits:bigint>>",
        scan,
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
