import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cairnflow.operators import detect, forest


@pytest.fixture(scope="module")
def rows(spark):
    draw = lambda n, k: F.pmod(F.hash("id", F.lit(k)), F.lit(n)) * 1.0
    rows = spark.range(3000).select("id", draw(100, 1).alias("size"), F.when(F.col("id") % 13 != 0, draw(7, 2)).alias("fees"), draw(1000, 3).alias("total_BTC"), (F.col("id") % 49 + 1).alias("time_step"))
    return rows.withColumn("target", ((F.col("size") > 60) & (F.col("total_BTC") > 300)).cast("int")).withColumn("label", 2 - F.col("target")).localCheckpoint()


def test_forest_counts_every_row_and_takes_the_best_split(spark, rows):
    features = ["size", "fees", "total_BTC"]
    c = detect.train(rows, features, trees=3)
    x = detect.values(rows, features, c.fill)
    got = [r["cells"] for r in forest._blocks(rows, x, F.col("target"), c.forest.cuts).orderBy("block").collect()]
    ids = [r["block"] for r in forest._blocks(rows, x, F.col("target"), c.forest.cuts).orderBy("block").collect()]
    blocks = [np.frombuffer(b, np.uint8).reshape(4, -1) for b in got]
    assert sum(b.shape[1] for b in blocks) == 3000
    every = np.array([[float(v) for v in r] for r in rows.select(*x, "target").collect()])
    for j in range(3):
        assert sorted(np.concatenate([b[j] for b in blocks])) == sorted(np.searchsorted(c.forest.cuts[j], every[:, j]))
    for t, tree in enumerate(c.forest.trees):
        w = np.concatenate([forest.drawn(42, i, t, b.shape[1], forest._poisson()) for i, b in zip(ids, blocks, strict=True)])
        cells = np.concatenate(blocks, 1)
        y, own = cells[3] == 1, np.array(c.forest.weights)
        assert tree[0][0].tolist() == [w[~y].sum(), w[y].sum()]
        gini = lambda on: (s := np.array([w[on & ~y].sum(), w[on & y].sum()]) * own).sum() - (s**2).sum() / max(s.sum(), 1e-9)  # noqa: E731, B023
        # every node: the rows that come to it, and no better split of its random features
        rows_at = {0: np.ones(3000, bool)}
        level = [0]
        for depth in range(3):
            subset = np.random.default_rng([42, t, depth]).random((len(level), 3)).argsort(1)[:, :2]
            below = []
            for i, at in enumerate(level):
                on, (counts, gain, f, b, left, right) = rows_at[at], tree[at]
                assert counts.tolist() == [w[on & ~y].sum(), w[on & y].sum()]
                best = 0.0
                for j in subset[i]:
                    for k in range(31):
                        side = on & (cells[j] <= k)
                        if min(w[side].sum(), w[on & ~side].sum()) >= 2:
                            best = max(best, (gini(on) - gini(side) - gini(on & ~side)) / (counts * own).sum())
                assert max(gain, 0.0) == pytest.approx(best, abs=1e-9)
                if left >= 0:
                    rows_at[left], rows_at[right] = on & (cells[f] <= b), on & (cells[f] > b)
                    below += [n for n in (left, right) if tree[n][0].min() > 0 and tree[n][0].sum() >= 4]
            level = below


def test_forest_scores_as_its_mllib_form(rows):
    c = detect.train(rows, ["size", "fees", "total_BTC"], trees=25)
    own = c.score(rows).select("id", "probability", "prediction", "target")
    other = c.model.transform(detect.filled(rows, c.features, c.fill)).select("id", vector_to_array("probability")[1].alias("q"))
    r = own.join(other, "id").agg(F.max(F.abs(F.col("probability") - F.col("q"))).alias("off"), F.avg((F.col("prediction") == F.col("target")).cast("int")).alias("right")).first()
    assert r["off"] < 1e-12 and r["right"] > 0.97


def test_counts_do_not_depend_on_blocks(rows, monkeypatch):
    x, label = [F.col("size")], F.col("target")
    monkeypatch.setattr(forest, "ROWS", 100)
    small = forest._blocks(rows, x, label, [np.arange(9.0)]).agg(F.sum("n").alias("n"), F.count_distinct("block").alias("k"), F.count(F.lit(1)).alias("all")).first()
    assert small["n"] == 3000 and small["k"] == small["all"]
    assert len(forest.cut_points(list(range(255)))) == 31 and forest.cut_points([2.0, 1.0, 2.0, float("nan")]).tolist() == [1.0, 2.0] and len(forest.cut_points(None)) == 0


def test_progression_trains_once_for_equal_columns(rows, monkeypatch):
    calls, train = [], detect.train
    monkeypatch.setattr(detect, "train", lambda *a, **k: calls.append(a[1]) or train(*a, **k))
    first, later = detect.temporal_split(rows.withColumn("pagerank", F.col("fees") / 7))
    out = {r["feature_set"]: r for r in detect.progression(first, later, 5).collect()}
    assert calls == [["fees", "size", "total_BTC"], ["fees", "size", "total_BTC", "pagerank"]] or [sorted(c) for c in calls] == [["fees", "size", "total_BTC"], ["fees", "pagerank", "size", "total_BTC"]]
    assert out["M1"]["n_features"] == 3 and out["M2"][1:] == out["M3"][1:] and out["M3"]["accuracy"] > 0.95


def test_rolling_origin_fits_no_mllib_forest_and_leaves_out_one_sided_origins(rows, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    def fit(*a, **k):
        raise AssertionError("a forest of MLlib walks every tree for every row")

    monkeypatch.setattr(RandomForestClassifier, "fit", fit)
    some = rows.where("time_step > 5 and (time_step <= 40 or target = 0)")
    out = detect.rolling_origin(some, ["size", "fees", "total_BTC"], "id", cutoffs=(3, 20, 44), trees=5).collect()
    assert [r["cutoff"] for r in out] == [20] and out[0]["ml_pr_auc"] > 0.9
    n, y = some.where("time_step between 21 and 25").agg(F.count(F.lit(1)), F.sum("target")).first()
    assert (out[0]["n_test"], out[0]["n_positive"], out[0]["base_rate"]) == (n, y, y / n)
    before, after = some.where("time_step <= 20"), some.where("time_step between 21 and 25")
    scored = detect.train(before, ["size", "fees", "total_BTC"], trees=5).score(after)
    m = detect.bundle(scored, "probability", (100,)).first()
    assert out[0]["ml_pr_auc"] == pytest.approx(m["pr_auc"]) and out[0]["ml_precision_at_100"] == pytest.approx(m["precision_at_100"])
