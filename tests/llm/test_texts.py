"""Scanning operators: licenses, secrets, classifiers, pieces."""

import hashlib
import random
import re

import numpy as np
import pytest
import regex

from cairnflow.llm import license_scan, pieces, quality, secret_scan, toxicity

SCHEMA = "doc_id bigint, text string, source string, score double"
EDGES = [(1, None, None, 1.0), (2, "", "a", 2.0), (None, "plain text here", "a", 3.0), (3, "same", "b", 4.0), (3, "same", "b", 4.0), (4, "word " * 30_000, "c", None)]


def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def by_text(rows, text):
    return [r for r, e in zip(rows, EDGES, strict=True) if e[1] == text]


def test_license_scan_matches_fuzzy_search_of_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80).toPandas()
    rng = random.Random(3)
    notice = license_scan.NOTICES[0][1]
    for i in range(0, 60):
        broken = list(notice)
        for _ in range(rng.randint(0, 8)):
            broken[rng.randrange(len(broken))] = rng.choice("abcxyz ")
        at = rng.randint(0, len(docs.text[i]))
        docs.loc[i, "text"] = docs.text[i][:at] + " " + "".join(broken) + " " + docs.text[i][at:]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(docs[["doc_id", "text"]])).collect()}
    for _, d in docs.iterrows():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", d.text.translate({c: c + 32 for c in range(65, 91)}))
        r = got[d.doc_id]
        assert r.n_words == len(words)
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.decode().split()
            for i in range(len(words)):
                if words[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels))
        joined = " ".join(words).encode()
        for label, text, edits in license_scan.NOTICES:
            if regex.search(b"(?:" + text.encode() + b"){e<=%d}" % edits, joined):
                labels.add(label)
        assert r.labels == ",".join(sorted(labels))
        assert 0 <= r.score <= 1


def test_license_edges(spark):
    rows = license_scan.scan_licenses(edges(spark)).collect()
    assert [r.n_words for r in rows] == [0, 0, 3, 1, 1, 30_000]
    assert all((r.n_base, r.first_word, r.labels, r.score) == (0, None, "", 0.0) for r in rows)
    assert license_scan.scan_licenses(edges(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.compiled([("x", "short notice", 5)])


def brute_spans(text):
    found = []
    for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]


def test_secret_scan_base_and_ownership(spark):
    rng, rows = random.Random(5), []
    bits = ["password = ", "PASSWD:", "token=key=", "api_key: '", "AKIA", "ſecret=", "0123456789abcdef", "deadbeef", "é ", "x", "ABCDEF0123456789", "hunter22", "  ", "\n", "Token : "]
    for i in range(120):
        rows.append((i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))), f"s{i % 6}"))
    live, copied = "ghp_" + "aB3" * 12, "ghp_" + "zY9" * 12
    rows += [(1000, f"x {live}", "s1"), (1001, f"again {live}", "s1")] + [(1100 + i, f"y {copied} z", f"s{i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    per_doc, found = secret_scan.scan_secrets(docs)
    got = {r.doc_id: r for r in per_doc.collect()}
    for i, text, _ in rows:
        spans = brute_spans(text)
        assert got[i].base == ",".join(spans)
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[i].n_assign == sum(s.startswith("assign") for s in spans)
    verdicts = {(r.doc_id, r.kind): (r.verdict, r.n_owners, r.n_repos) for r in found.where("not base and kind = 'github'").collect()}
    assert verdicts[1000, "github"] == ("live", 1, 2) and verdicts[1100, "github"] == ("example", 4, 4)


def test_secret_query_spans(spark, tmp_path):
    live = "ghp_" + "aB3" * 12
    docs = spark.createDataFrame([(1, f"password=abcdef1 {live}", "a"), (2, None, None), (2, None, None)], "doc_id bigint, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = secret_scan.op9_secret_scan(spark, str(tmp_path)).collect()
    first = next(r for r in rows if r.doc_id == 1)
    assert first.spans == f"assign:0:16,github:17:{17 + len(live)},mixed:17:{17 + len(live)}" and first.n_assign == 1
    assert sum(r.doc_id == 2 and r.spans == "" for r in rows) == 2
    assert secret_scan.scan_secrets(docs.limit(0))[0].count() == 0


def test_private_keys_are_owned_one_by_one(spark, tmp_path):
    key = lambda c, lines=3: "-----BEGIN RSA PRIVATE KEY-----\n" + f"MII{c}/+{c * 58}\n" * lines + f"{c}Q==\n-----END RSA PRIVATE KEY-----"
    a, b, known = key("A"), key("B"), key("C")
    cut = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n" + "/D+z" * 16 + "\n"
    rows = [(1, f"x {a} y", "s1"), (2, f"é {b}", "s2"), (3, f"{b} twice", "s2"), (4, cut + "and prose", "s3"), (5, a.replace("\n", "\\n"), "s1")]
    rows += [(10 + i, known.replace("\n", "\r\n  ") if i else known, f"s{i}") for i in range(4)]
    rows += [(20, "the line -----BEGIN RSA PRIVATE KEY----- alone", "s1")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("pem")] for r in secret_scan.op9_secret_scan(spark, str(tmp_path)).collect()}
    assert got[1] == [f"pem:2:{2 + len(a)}"] and got[2] == [f"pem:2:{2 + len(b)}"] and got[3] == [f"pem:0:{len(b)}"]
    assert got[4] == [f"pem:0:{len(cut) - 1}"] and got[5] == [f"pem:0:{len(rows[4][1])}"]
    assert all(got[10 + i] == [] for i in range(4))
    assert got[20] == ["pem:9:40"]
    values = {v for text in (a, a.replace("\n", "\\n"), a.replace("\n", "\r\n\t")) for _, k, _, v in secret_scan.shape_spans(text) if k == "pem"}
    assert len(values) == 1


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.85)])
def test_classifiers_on_held_out_rows(spark, module, label, least):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = module.classify(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = out.join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows[label].to_numpy(), rows.score.to_numpy()) >= least
    assert rows.score.between(0, 1).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, module):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = module.classify(edges(spark), labels).collect()
    assert len(rows) == len(EDGES) and all(r.score == 0.5 for r in rows)
    assert next(r for r in rows if r.doc_id is None).held_out is True
    assert module.classify(edges(spark).limit(0), labels).count() == 0
    some = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (3, None, None), (4, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert module.classify(edges(spark), some).count() == len(EDGES)


def test_quality_fit_equals_dense_ridge_and_isotonic_means(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    stats = quality.stash(quality.document_statistics(docs.repartition(5)), "stats")
    kernel, w, steps = quality.fit(stats, labels)
    import pyspark.sql.functions as F

    y = labels.where(~quality.held_out(F.col("doc_id"))).where("quality is not null").select("doc_id", "quality")
    rows = stats.join(y, "doc_id").withColumn("fold", quality.fold_of("doc_id")).toPandas()
    x, target, fold = np.stack(rows.stats.to_numpy()), rows.quality.to_numpy(float), rows.fold.to_numpy()
    assert np.allclose(kernel.mean, x.mean(0)) and np.allclose(kernel.scale, x.std(0) + 1e-6, rtol=1e-6, atol=1e-6)
    z = np.array([np.concatenate([4 * np.sqrt(2 / quality.FEATURES) * np.cos([sum(v * a for v, a in zip(c, kernel.w[:, j], strict=True)) + kernel.b[j] for j in range(quality.FEATURES)]), 0.3 * c, [1.0]]) for c in np.clip((x - kernel.mean) / kernel.scale, -5, 5)])

    def solve(at):
        a = np.vstack([z[at], np.sqrt(quality.RIDGE) * np.eye(z.shape[1])])
        return np.linalg.lstsq(a, np.concatenate([target[at], np.zeros(z.shape[1])]), rcond=None)[0]

    assert np.allclose(w, solve(np.arange(len(z))), atol=1e-6)
    raw = np.array([z[i] @ solve(np.flatnonzero(fold != fold[i])) for i in range(len(z))])
    at = quality.bin_of(raw)
    for b in set(at):
        least = [min(target[(at >= lo) & (at <= hi)].mean() for hi in set(at) if hi >= b) for lo in set(at) if lo <= b]
        assert steps[b] == pytest.approx(max(least), abs=1e-9)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    kept = {r.doc_id for r in quality.good_rows(docs, labels).collect()}
    assert kept == {i for i, s in got.items() if s >= quality.THRESHOLD}


def plain_ftrl(rows, y, order):
    """One weight at a time, in dictionaries."""
    z, n = {}, {}

    def weight(i, l1):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= l1 else (l1 * (1 if a > 0 else -1) - a) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for r in order:
        w = {i: weight(i, 0.0 if i == 0 else toxicity.L1) for i in rows[r]}
        g = (1 / (1 + np.exp(-np.clip(sum(w.values()), -35, 35))) - y[r]) * (toxicity.POSITIVE if y[r] else 1.0)
        for i in rows[r]:
            sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return {i: v for i in z if (v := weight(i, 0.0 if i == 0 else toxicity.L1))}


def test_toxicity_weights_equal_a_plain_loop(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    import pyspark.sql.functions as F
    import xxhash

    y = labels.where(~toxicity.held_out(F.col("doc_id"))).where("toxic is not null").select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").join(y, "doc_id").toPandas()
    rows["shard"] = [xxhash.xxh64_intdigest(str(i)) % toxicity.SHARDS for i in rows.doc_id]
    want, seen = {}, 0
    for _, part in rows.groupby("shard"):
        part = part.assign(key=part.doc_id.astype(str)).sort_values("key")
        at = [toxicity.coordinates(t or "").tolist() for t in part.text]
        draw = np.random.default_rng(3)
        order = np.concatenate([draw.permutation(len(at)) for _ in range(toxicity.EPOCHS)])
        w = plain_ftrl(at, part.toxic.to_numpy(float), order)
        seen += len(part) if 0 in w else 0
        for i, v in w.items():
            want[i] = want.get(i, 0.0) + v * len(part)
    found, weights = toxicity.fit(docs, labels)
    got = dict(zip(found.tolist(), weights.tolist(), strict=True))
    assert set(got) == set(want) and len(got) > 50
    assert all(got[i] == pytest.approx(v / seen, rel=1e-6, abs=1e-9) for i, v in want.items())


def test_isotonic_pools_violators():
    p, n = np.array([0.0, 3, 1, 0, 4]), np.array([4.0, 4, 4, 0, 4])
    v = quality.isotonic(p, n)
    assert np.allclose(v, [0, 0.5, 0.5, 0.75, 1.0]) and (np.diff(v) >= 0).all()


def test_good_rows_keep_their_columns(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = quality.good_rows(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert kept.columns == docs.columns
    left = kept.select("doc_id").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (left.quality == 1).mean() > 0.97


LETTERS = "ab c▁  \n\t.,éñ漢🙂lthei"


def test_pieces_equal_the_library_and_decode(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    table, lib = pieces.PieceTable.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 90))) for _ in range(400)] + ["a" * 3000, "hello" * 500, "    " * 40 + "x", "=-" * 400]
    docs = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)] + [(None, None, None), (7, "again", "x"), (7, "again", "x")], "doc_id bigint, text string, ids string")
    out = pieces.encode(docs, table)
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    rows = out.collect()
    assert all(r.round_trip for r in rows) and len(rows) == len(texts) + 3
    for r, t in zip(rows, texts, strict=False):
        assert r.ids == lib.encode(t) and r.n_tokens == len(r.ids)
    assert rows[len(texts)].ids == []
    back = [r.text for r in pieces.decode(out, table).collect()]
    assert back[: len(texts)] == [t.replace("▁", " ") for t in texts]
    assert pieces.encode(docs.limit(0), table).count() == 0


def test_relational_lattice_equals_the_partition_lattice(spark):
    table = pieces.PieceTable.load()
    words = ["▁hello", "▁▁the", "naïve,", "▁don't", "🙂x", "▁", "zzzz", "▁quickly.", "0x41"]
    lattice = pieces.Lattice(table)
    want = {w: np.frombuffer(lattice.word(w), dtype=np.int32).tolist() for w in words}
    got = {r.word: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
    assert got == want


def test_viterbi_folds_agree_and_are_optimal(spark):
    scored = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], *[(p, s, 1) for p, s in (("a", -2.0), ("b", -2.5), ("ab", -3.0), ("ba", -3.1), ("aba", -4.2), ("c", -1.0), ("bc", -2.9))]]
    table = pieces.PieceTable(scored, bpe=False, prefix=False)
    words = ["ababc", "cabab", "abcd", "d", "bbaabc"]
    lattice, ids = pieces.Lattice(table), {p: s for p, s, k in scored if k == 1}

    def best(w):
        if not w:
            return 0.0
        return max([ids[w[:i]] + best(w[i:]) for i in range(1, len(w) + 1) if w[:i] in ids] + ([-14.2 + best(w[1:])] if w[0] not in ids else []))

    got = {r.word: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
    for w in words:
        bounds = lattice.viterbi(w)
        total = sum(ids.get(w[a:b], -14.2) for a, b in zip(bounds, bounds[1:], strict=False))
        assert total == pytest.approx(best(w))
        assert got[w] == lattice.spell(w, bounds)
