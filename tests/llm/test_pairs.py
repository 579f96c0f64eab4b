"""Operators across documents: dedup, mixing, substrings, neighbours, the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from cairnflow.llm import exact_dedup, near_dedup, neighbours, source_mixing, substring_dedup

SCHEMA = "doc_id bigint, text string, source string, kept string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "k", "d") for i, t, s in rows], SCHEMA)


#: Names that operators use inside, and of their results.
CLASH = ["own", "row", "key", "salt", "salts", "text_", "copies", "copy", "size", "tie", "target", "taken", "spans", "span_doc", "cut", "start", "stays", "win_id", "keep_row", "keep_id", "kept", "group_size",
    "digest", "best", "n", "batch", "class_id", "class_size", "component", "node", "bands", "score", "ids", "n_tokens", "round_trip", "__digest", "__copy", "_metadata", "Digest2", "file.name", "vec_id", "rank"]


def clashing(spark, rows):
    """Rows with extra columns named like every internal one; each holds its row's number."""
    names = ", ".join(f"`{c}` bigint" for c in CLASH)
    return spark.createDataFrame([(i, t, s, *[n] * len(CLASH)) for n, (i, t, s) in enumerate(rows)], f"doc_id bigint, text string, source string, {names}")


def same_columns(out, docs):
    """``out`` has the columns of ``docs``, and the extra ones of a row still agree."""
    assert out.columns == docs.columns
    got = out.collect()
    for r in got:
        assert len(set(r[3:])) == 1
    return [(r[0], r[1], r[2], r[3]) for r in got]


def words(rng, n, of=400):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def copies(seed=1, groups=12, size=6, n=120):
    """Documents with exact copies, near copies and strangers, nulls, empties and repeated rows."""
    rng, rows, i = random.Random(seed), [], 0
    for _ in range(groups):
        base = words(rng, n, 5000)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join(w), f"s{i % 3}"))
            i += 1
    rows += [(1000, None, None), (1001, "", "s1"), (1002, "   ", "s1"), (1003, "a b", "s0"), (1004, "a b", "s0"), (None, "null id text", "s0"), (1005, "twice", "s0"), (1005, "twice", "s0")]
    return rows


def shingle_sets(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_sets(t) for _, t, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "")
            if same or (sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for a in range(len(rows)):
        groups[root(a)].append(rows[a][0])
    return sorted(sorted((x is None, x or 0) for x in g) for g in groups.values())


@pytest.mark.parametrize(("paired", "block"), [(6, 256), (1, 2)])
def test_near_classes_equal_brute_force(spark, monkeypatch, paired, block):
    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = copies()
    out = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    groups = defaultdict(list)
    for r in out:
        groups[r.class_id].append(r.doc_id)
        assert r.class_size >= 1
    got = sorted(sorted((x is None, x or 0) for x in g) for g in groups.values())
    assert got == brute_classes(rows)
    assert sum(r.kept for r in out) == len(got)


def test_blocks_give_a_link_for_each_join(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [("k", 0, 1, 0, side, i, i, f"{text} e{i}") for i in range(30) for side in (True, False)]
    tasks = spark.createDataFrame(rows, "key string, l long, kind int, o long, left boolean, node long, class long, text string")
    found = near_dedup.compare_blocks(tasks, np.ones(1 << near_dedup.DF_BITS, dtype=np.float32), 0.8).collect()
    joined = near_dedup.Joined()
    assert len(found) == 29 and all(joined.join(r.a, r.b) for r in found)


def test_near_empty_table(spark):
    assert near_dedup.near_duplicates(frame(spark, copies()).limit(0)).count() == 0


def test_consistent_samples_estimate_weighted_similarity():
    rng, sampler = np.random.default_rng(0), near_dedup.Sampler()
    s = rng.integers(0, 2**63, 400, dtype=np.uint64)
    w = rng.uniform(0.5, 3, 400)
    hits = trials = 0
    for _ in range(60):
        keep = rng.random(400) < 0.9
        a, b = (s, w), (s[keep], w[keep])
        j = w[keep].sum() / w.sum()
        same = sum(x == y for x, y in zip(sampler.bands(*a), sampler.bands(*b), strict=True))
        hits, trials = hits + same, trials + near_dedup.BANDS * j**near_dedup.ROWS
    assert hits == pytest.approx(trials, rel=0.12)


def test_long_texts_do_not_share_draws():
    rng, sampler = np.random.default_rng(1), near_dedup.Sampler()
    s = rng.integers(0, 2**63, 200_000, dtype=np.uint64)
    hits = trials = 0
    for _ in range(12):
        w = rng.uniform(0.5, 3, len(s))
        keep = rng.random(len(s)) < 0.9
        j = w[keep].sum() / w.sum()
        same = sum(x == y for x, y in zip(sampler.bands(s, w), sampler.bands(s[keep], w[keep]), strict=True))
        hits, trials = hits + same, trials + near_dedup.BANDS * j**near_dedup.ROWS
        s = rng.integers(0, 2**63, 200_000, dtype=np.uint64)
    assert hits == pytest.approx(trials, rel=0.15)
    other = rng.integers(0, 2**63, 200_000, dtype=np.uint64)
    assert not set(sampler.bands(s, np.ones(len(s)))) & set(sampler.bands(other, np.ones(len(s))))


def test_document_frequencies_are_counts(spark):
    rows = [t for _, t, _ in copies(4)]
    df, n = near_dedup.document_frequencies(spark.createDataFrame([(t,) for t in rows], "text string").repartition(7))
    want = np.zeros(1 << near_dedup.DF_BITS, dtype=np.int64)
    for t in rows:
        want[np.unique(near_dedup.buckets(near_dedup.shingles(t or "")[0]))] += 1
    assert n == len(rows) and (df == want).all()


def weighted_sets(rows):
    """TF-IDF weights of each text's shingles, counted here shingle by shingle, without hash buckets."""
    counts = []
    for _, t, _ in rows:
        w = (t or "").split()
        counts.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(s for c in counts for s in c)
    idf = {s: np.log1p(min(len(rows) / k, 1 / near_dedup.COMMON)) for s, k in df.items()}
    return [{s: k * idf[s] for s, k in c.items()} for c in counts]


def test_weighted_similarity_equals_brute_force(spark):
    rows = copies(5, 6, 4, 60)
    df, n = near_dedup.document_frequencies(frame(spark, rows))
    idf, sets = near_dedup.inverse_frequencies(df, n), weighted_sets(rows)
    for a in range(0, len(rows) - 8, 3):
        for b in range(a + 1, min(a + 6, len(rows) - 8)):
            x, y = sets[a], sets[b]
            low = sum(min(x.get(s, 0), y.get(s, 0)) for s in x)
            plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
            got = near_dedup.jaccard(near_dedup.weights_of(rows[a][1], idf), near_dedup.weights_of(rows[b][1], idf))
            assert got == pytest.approx(max(low / (sum(x.values()) + sum(y.values()) - low), plain), abs=1e-5)


def test_one_of_each_keeps_rows_and_columns(spark):
    rows = copies()
    docs = frame(spark, rows)
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(brute_classes(rows))


def test_exact_index_over_batches(spark):
    rows = copies(2)
    index = exact_dedup.fresh_index(spark, buckets=4)
    out = index.add(frame(spark, rows)).collect()
    by = defaultdict(list)
    for i, t, _ in rows:
        by[hashlib.sha256((t or "").encode()).digest()].append(i)
    assert len(out) == len(rows)
    for r in out:
        ids = by[bytes(r.digest)]
        assert r.group_size == len(ids) and r.keep_id == max((x for x in ids if x is not None), default=None)
    assert sum(r.kept for r in out) == len(by)
    more = index.add(frame(spark, [*rows[:5], (5000, "brand new", "s0")])).collect()
    assert [r.doc_id for r in more if r.kept] == [5000]
    assert index.table().count() == len(by) + 1
    again = exact_dedup.DigestIndex(spark, "reopened", index.path, buckets=4)
    assert again.table().count() == len(by) + 1
    assert index.add(frame(spark, rows).limit(0)).count() == 0


def test_a_batch_added_again_keeps_its_rows(spark):
    rows = copies(2)
    index = exact_dedup.fresh_index(spark, buckets=4)
    index.add(frame(spark, rows[:10]), batch="a")
    once = sorted((str(r.doc_id), r.kept, r.group_size) for r in index.add(frame(spark, rows), batch="b").collect())
    again = sorted((str(r.doc_id), r.kept, r.group_size) for r in index.add(frame(spark, rows), batch="b").collect())
    assert once == again and sum(x[1] for x in once) == len({t or "" for _, t, _ in rows} - {t for _, t, _ in rows[:10]})
    assert index.table().count() == len({t or "" for _, t, _ in rows})
    assert not any(r.kept for r in index.add(frame(spark, rows), batch="c").collect())


def test_rows_keep_columns_of_any_name(spark, tmp_path):
    rows = [*copies(3, 4, 4), (1005, "twice", "s0")]
    clashing(spark, rows).write.parquet(str(tmp_path / "docs"))
    for docs in (clashing(spark, rows), spark.read.parquet(str(tmp_path / "docs"))):
        kept = same_columns(exact_dedup.distinct_rows(docs, exact_dedup.fresh_index(spark, buckets=4)), docs)
        assert sorted(t or "" for _, t, _, _ in kept) == sorted({t or "" for _, t, _ in rows})
        assert len(same_columns(near_dedup.one_of_each(docs), docs)) == len(brute_classes(rows))
        mixed = Counter(same_columns(source_mixing.mixed_rows(docs), docs))
        assert mixed.total() == sum(r.copies for r in source_mixing.mix(docs).collect())
        assert len(same_columns(substring_dedup.remove_repeats(docs), docs)) == len(rows)
        added = exact_dedup.fresh_index(spark, buckets=4).add(docs)
        assert [c for c in added.columns if c not in ("digest", "keep_id", "group_size", "kept")] == [c for c in docs.columns if c not in ("text", "digest", "keep_id", "group_size", "kept")]
        assert added.count() == len(rows)
        assert near_dedup.near_duplicates(docs).count() == len(rows)


def test_repeated_rows_stay_whole_and_in_their_source(spark):
    rows = [(1, "one two three four", "a"), (1, "one two three four", "b"), (1, "one two three four", "b"), (None, "five six", None), (None, "five six", None)]
    docs = frame(spark, rows)
    want = Counter()
    for r in source_mixing.mix(docs).collect():
        want[(r.doc_id, r.source)] += r.copies
    got = Counter((r.doc_id, r.source) for r in source_mixing.mixed_rows(docs).collect())
    assert got == +want
    passage = " ".join(f"Word{k} " + " ".join(f"x{k}y{n}" for n in range(10)) + "." for k in range(5))
    texts = [r.text for r in substring_dedup.remove_repeats(frame(spark, [(7, passage, "a"), (7, passage, "a"), (None, passage, "a"), (None, None, "a")])).collect()]
    assert sorted(t or "" for t in texts) == ["", "", "", passage] and None in texts


def test_empty_tables(spark):
    docs = frame(spark, copies()).limit(0)
    assert exact_dedup.distinct_rows(docs, exact_dedup.fresh_index(spark, buckets=4)).count() == 0
    assert near_dedup.one_of_each(docs).count() == 0
    assert source_mixing.mixed_rows(docs).count() == 0
    assert substring_dedup.remove_repeats(docs).count() == 0


def test_a_mix_that_does_not_converge_raises(spark):
    docs = frame(spark, [(i, "w " * (1 + i % 37), "ab"[i % 2]) for i in range(400)])
    import pyspark.sql.functions as F

    h = docs.select("source", source_mixing.word_count(docs.text).alias("size")).groupBy("source", "size").agg(F.count("*").alias("docs"))
    s = h.groupBy("source").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("size")).alias("words"))
    with pytest.raises(RuntimeError, match="converge"):
        source_mixing.balance(h, source_mixing.targets(s), steps=1)


def test_distinct_rows(spark):
    rows = copies(2)
    out = exact_dedup.distinct_rows(frame(spark, rows), exact_dedup.fresh_index(spark, buckets=4))
    assert out.columns == frame(spark, rows).columns
    texts = [r.text or "" for r in out.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, _ in rows})


def reshare(sizes, weights, share, cap):
    """Targets by giving the excess of full sources to the others until none is above its cap."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]] if total else []
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = cap * sizes[s]
        left = share * sum(sizes.values()) - sum(full.values())


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.choice([1, 5, 20, 60, 200]))), rng.choice(["a", "a", "a", "b", "c", "é", "Z", None])) for i in range(600)]
    rows += [(9000, None, "a"), (9001, "", "b"), (None, "one two", "a"), (9002, "x y z", "a"), (9002, "x y z", "a")]
    docs = frame(spark, rows)
    out = source_mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = reshare(dict(sizes), source_mixing.WEIGHTS, 1.5, 2.0), Counter()
    for r in out:
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=30)
    again = source_mixing.mix(docs).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.copies)
    assert sorted(map(key, out)) == sorted(map(key, again))
    mixed = source_mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert source_mixing.mix(docs.limit(0)).count() == 0


def test_rates_solve_the_dual(spark):
    docs = frame(spark, [(i, "w " * (1 + i % 37), "ab"[i % 2]) for i in range(400)])
    h = docs.select("source", source_mixing.word_count(docs.text).alias("size")).groupBy("source", "size").count().withColumnRenamed("count", "docs")
    import pyspark.sql.functions as F

    s = h.groupBy("source").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("size")).alias("words"))
    lam = {r.source: r for r in source_mixing.balance(h, source_mixing.targets(s)).collect()}
    for name, r in lam.items():
        if not r.full:
            rows = [x for x in h.collect() if x.source == name]
            got = sum(x.docs * x["size"] * min(2.0, np.exp(r.lam * x["size"] * r.n / r.words)) for x in rows)
            assert got == pytest.approx(r.target, rel=1e-6)


def brute_removed(rows):
    first, gone, cut = {}, defaultdict(set), {}
    for i, t, _ in sorted(rows):
        at, found = substring_dedup.runs(t or "")
        cut[i] = at
        for p, n, h in found:
            if h in first:
                gone[i].update(range(p, p + n))
            else:
                first[h] = (i, p)
    return {i: sorted(cut[i][p] for p in ps) for i, ps in gone.items()}


def plain_sentences(text):
    """Sentences by walking over the letters: they end with marks before white space, at a line's end, or with the text."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i].isspace():
            i += 1
            continue
        j = i + 1
        while j < n and text[j] != "\n":
            if text[j] in ".!?" and (j + 1 == n or text[j + 1].isspace()):
                j += 1
                break
            j += 1
        out.append((i, j))
        i = j
    return out


def plain_runs(text):
    """(first, end, sentences) of every run, from all pairs of ends."""
    at = plain_sentences(text)
    words = [len(text[a:b].split()) for a, b in at]
    size = lambda i, j: sum(words[i:j])
    enough = lambda i, j: size(i, j) >= substring_dedup.RUN_WORDS
    n, picked = len(at), set()
    for i in range(n):
        if words[i] >= substring_dedup.LONG_WORDS:
            picked.add((i, i + 1))
        for j in range(i + 2, n + 1):
            if enough(i, j) and (not any(enough(i, k) for k in range(i + 2, j)) or not any(enough(k, j) for k in range(i + 1, j - 1))):
                if j == i + 1 or any(w < substring_dedup.LONG_WORDS for w in words[i:j]):
                    picked.add((i, j))
    return at, [(i, j, tuple(text[a:b] for a, b in at[i:j])) for i, j in picked]


def test_repeats_equal_a_splitter_of_its_own(spark):
    rng, rows = random.Random(16), []
    pool = [" ".join(words(rng, rng.randint(2, 24), 3000)).capitalize() + rng.choice([".", "!", "?!", "..."]) for _ in range(30)]
    for i in range(40):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(words(rng, rng.randint(1, 18), 3000)) + "." for _ in range(rng.randint(1, 10))]
        rows.append((i, "".join(p + rng.choice([" ", "  ", "\n", " \n"]) for p in parts), "s"))
    first, gone = {}, defaultdict(set)
    for i, t, _ in rows:
        at, found = plain_runs(t)
        for a, b, key in sorted(found):
            if key in first and first[key] != (i, a):
                gone[i].update(at[a:b])
            first.setdefault(key, (i, a))
    got = defaultdict(set)
    for r in substring_dedup.repeated_spans(frame(spark, rows)).collect():
        got[r.doc_id].update((a, b) for a, b in plain_sentences(rows[r.doc_id][1]) if r.start <= a and b <= r.end)
    assert got == gone and len(gone) > 10


def test_repeated_sentences_equal_brute_force(spark):
    rng, rows = random.Random(6), []
    passage = " ".join(" ".join(words(rng, 12)).capitalize() + "." for _ in range(6))
    for i in range(40):
        own = [" ".join(words(rng, rng.randint(2, 18), 3000)).capitalize() + "." for _ in range(rng.randint(1, 12))]
        if i % 4 == 0:
            own.insert(rng.randint(0, len(own)), passage)
        rows.append((i, (" " if i % 2 else "\n").join(own), "s"))
    rows += [(100, rows[3][1], "s"), (101, None, "s"), (102, "", "s"), (103, "no end here " * 30, "s"), (104, "no end here " * 30, "s")]
    spans = defaultdict(list)
    for r in substring_dedup.repeated_spans(frame(spark, rows)).collect():
        spans[r.doc_id].append((r.start, r.end))
    want = brute_removed(rows)
    assert set(spans) == set(want)
    texts = {i: t for i, t, _ in rows}
    for i, parts in want.items():
        for a, e in parts:
            assert any(x <= a and e <= y for x, y in spans[i])
        assert sum(len(texts[i][a:e].split()) for a, e in parts) == sum(len(texts[i][a:e].split()) for a, e in spans[i])
    assert {4, 8, 12, 36, 100, 104} <= set(spans) and 0 not in spans and 1 not in spans
    clean = {r.doc_id: r.text for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert passage in clean[0] and passage.split(". ")[2] not in clean[4] and clean[1] == texts[1] and clean[101] is None
    assert len(clean[100].split()) < substring_dedup.RUN_WORDS  # a tail too short for a run of its own stays
    assert substring_dedup.repeated_spans(frame(spark, rows).limit(0)).count() == 0


def test_short_runs_tails_and_other_scripts_are_repeats(spark):
    pair = "Seven words stand in this first sentence. Then eight more words follow in the next."
    lone = "One single sentence " + " ".join(f"w{k}" for k in range(22)) + "."
    long = " ".join(f"Word{k} " + " ".join(f"x{k}y{n}" for n in range(10)) + "." for k in range(5)) + " A short tail."
    han = "这是第一个句子它有很多汉字在里面。第二个句子也有许多汉字写在这里面！"
    rows, n = [], 0
    for passage in (pair, lone, long, han):
        for _ in range(2):
            rows.append((n, f"Own{n} start{n} here{n}. {passage} Own{n} end{n} there{n} word{n}.", "s"))
            n += 1
    texts, cut = {i: t for i, t, _ in rows}, defaultdict(list)
    for r in substring_dedup.repeated_spans(frame(spark, rows)).collect():
        cut[r.doc_id].append(texts[r.doc_id][r.start : r.end])
    assert cut == {1: [pair], 3: [lone], 5: [long], 7: [han]}


def test_every_sentence_of_a_repeated_passage_is_in_a_run_inside_it():
    rng = random.Random(8)
    for _ in range(300):
        parts = [" ".join(words(rng, rng.randint(1, 24), 3000)).capitalize() + "." for _ in range(rng.randint(2, 9))]
        before, after = (" ".join(words(rng, 9, 3000)) + ".\n" for _ in range(2))
        _, inside = substring_dedup.runs(" ".join(parts))
        _, within = substring_dedup.runs(before + " ".join(parts) + "\n" + after)
        assert {h for _, _, h in inside} <= {h for _, _, h in within}
        covered = {k for p, n, _ in inside for k in range(p, p + n)}
        if sum(len(p.split()) for p in parts) >= substring_dedup.RUN_WORDS:
            assert covered == set(range(len(parts)))


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[700:760] = x[700]
    rows = [(int(i), [float(np.float32(v)) for v in x[i]]) for i in range(1500)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0]), (None, [1.0] * 16), (2080, [1.0, None] + [0.0] * 14), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id bigint, embedding array<float>, score string")
    out = neighbours.search(df, lambda c: c % 20 == 0).collect()
    y, got = np.array([r[1] for r in rows]), defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        hits += len({v for v, _ in found} & set(best.tolist()))
        assert len(found) == 20 and all(abs(sc - s[v]) < 1e-9 for v, sc in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits / (20 * len(got)) >= 0.9
    few = neighbours.search(df.where("vec_id < 5"), lambda c: c % 20 == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert neighbours.search(df.limit(0), lambda c: c % 20 == 0).count() == 0


def recall_of(found, x, queries, k=20):
    hits = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(found[q]) & set(np.lexsort((np.arange(len(x)), -s))[:k].tolist()))
    return hits / (k * len(queries))


@pytest.mark.parametrize(("sample", "leaf", "clusters"), [(1500, 8192, 0), (1500, 200, 40)])
def test_recall_beyond_the_sample_and_in_two_levels(spark, monkeypatch, sample, leaf, clusters):
    monkeypatch.setattr(neighbours, "SAMPLE", sample)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", leaf)
    monkeypatch.setattr(neighbours, "PER_PARTITION", 150)
    rng, n = np.random.default_rng(9), 6000
    x = rng.normal(size=(n, 16)) if not clusters else rng.normal(size=(clusters, 16))[rng.integers(0, clusters, n)] * 2 + rng.normal(size=(n, 16)) * 0.7
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in range(n)], "vec_id bigint, embedding array<double>")
    index, placed = neighbours.fit(neighbours.usable(df, "vec_id", "embedding"), 20)
    assert placed.count() == n and (index.parts > 10 if leaf == 200 else 2 < index.parts <= 10) and index.recall >= 0.95
    if leaf == 200:
        assert index.inner and index.probes < index.parts
    got = defaultdict(list)
    for r in neighbours.search(df, lambda c: c % 20 == 0).collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(range(0, n, 20)) and recall_of(got, x, range(0, n, 20)) >= 0.9


def test_equal_vectors_tie_to_smaller_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 24))
    x[100:300] = x[7]
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(neighbours.search(df, lambda c: c % 20 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        assert [v for v, _ in found] == np.lexsort((np.arange(400), -s))[:20].tolist()


def test_balanced_partition_is_balanced():
    x = np.random.default_rng(1).normal(size=(1000, 8))
    part = neighbours.balanced_partition(neighbours.knn(x, np.arange(1000), 8), 10)
    assert np.bincount(part, minlength=10).max() <= 106


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, corpus_pipeline.stash(stage(spark, out, sf))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        texts = [r.text or "" for r in before.collect()]
        if name == "exact dedup":
            assert sorted(r.text or "" for r in out.collect()) == sorted(set(texts))
        if name == "MinHash near dedup":
            assert out.count() == len(brute_classes([(r.doc_id, r.text, "") for r in before.collect()]))
        if name == "SentencePiece encoding":
            assert out.where("not round_trip").count() == 0 and out.count() == before.count()
    assert len(corpus_pipeline.STAGES) == 5
    empty = corpus_pipeline.STAGES[2][1](spark, docs.limit(0), sf)
    assert empty.count() == 0
