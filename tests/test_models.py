"""Model jobs on a separable seeded fixture (FIXTURES.md section 1, F5 shape)."""

import os
import tempfile

import numpy as np
import pytest
from conftest import SF001, SF0001
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vigil.models import iforest as ifo
from vigil.models import metrics as mt
from vigil.models import pipeline as pl
from vigil.models.split import split
from vigil.sources import views as v


@pytest.fixture(scope="module")
def fixture(spark):
    # 3 sensors, one row per minute each, ~15 % failure rows drawn from shifted distributions
    n = 3000
    r = spark.range(n).select(
        F.col("id").alias("reading_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id"))
         ).alias("timestamp"),
        F.format_string("sensor_%03d", (F.col("id") % 3 + 1).cast("int")).alias("sensor_id"),
        (F.rand(7) < 0.15).alias("_f"),
        F.randn(11).alias("_a"), F.randn(12).alias("_b"), F.randn(13).alias("_c"),
    )
    return r.select(
        "reading_id", "timestamp", "sensor_id",
        F.when(F.col("_f"), 75 + 10 * F.col("_a")).otherwise(30 + 5 * F.col("_a")).alias("temperature"),
        F.when(F.col("_f"), 4 + F.col("_b")).otherwise(1 + 0.3 * F.col("_b")).alias("vibration"),
        F.when(F.col("_f"), 2 + 0.5 * F.col("_c")).otherwise(5 + 0.8 * F.col("_c")).alias("pressure"),
        F.when(F.col("_f"), "failure").otherwise("normal").alias("label"),
    ).cache()


def test_split_is_stratified_and_stable(fixture):
    a = split(fixture).groupBy("label").agg(F.avg(F.col("is_test").cast("double")).alias("r")).collect()
    for row in a:
        assert 0.15 < row["r"] < 0.25
    b = split(fixture.repartition(7))
    assert split(fixture).filter("is_test").count() == b.filter("is_test").count()
    ex = split(fixture, exact=True).groupBy("label").agg(
        F.count_if("is_test").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    for row in ex:
        assert row["t"] == round(0.2 * row["n"])


def test_isolation_forest_rate_and_ranking(fixture):
    feats = ["temperature", "vibration", "pressure"]
    m = ifo.fit_isolation_forest(fixture, feats, n_trees=50)
    s = ifo.score_isolation_forest(m, fixture)
    rate = s.agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0]
    assert 0.07 < rate < 0.13
    # failure rows are the minority cluster: they must rank as more anomalous
    g = {r["label"]: r["m"] for r in s.groupBy("label").agg(F.avg("anomaly_score").alias("m")).collect()}
    assert g["failure"] < g["normal"]
    assert len(m.trees) <= 50 * (2 * 256 - 1)


def test_train_all_auc_and_round_trip(spark, fixture):
    models, metrics = pl.train_all(fixture, pl.feature_set("basic6"), n_trees=30, do_clean=True,
                                   forest_kw={"numTrees": 20})
    d = {(r["model"], r["metric"]): r["value"] for r in metrics.collect()}
    assert d[("random_forest", "auc_score")] > 0.95
    assert d[("sgd_classifier", "auc_score")] > 0.95
    scored = pl.score_all(pl.feat.interaction_features(fixture), models, features_ready=True)
    assert scored.count() == fixture.count()
    r = scored.agg(F.min("risk_score"), F.max("risk_score")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 + 1e-9
    path = tempfile.mkdtemp(prefix="vigil-models-")
    pl.save_models(models, path)
    again = pl.load_models(spark, path)
    s2 = pl.score_all(pl.feat.interaction_features(fixture), again, features_ready=True)
    a = {x["reading_id"]: x["risk_score"] for x in scored.select("reading_id", "risk_score").collect()}
    b = {x["reading_id"]: x["risk_score"] for x in s2.select("reading_id", "risk_score").collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9
    with pytest.raises(FileNotFoundError):
        pl.load_models(spark, os.path.join(path, "absent"))


def test_auc_frame_matches_evaluator(fixture):
    x = fixture.select((F.col("temperature") / 100).alias("s"),
                       F.when(F.col("label") == "failure", 1.0).otherwise(0.0).alias("y"))
    a = mt.auc_frame(x, "s").first()["auc"]
    b = mt.auc(x, "s")
    assert abs(a - b) < 1e-9


@pytest.mark.parametrize("n", [100, 5_000, 25_600, 26_000, 200_000])
def test_every_isolation_tree_has_its_sample(spark, n):
    r = spark.range(n).select(F.col("id").alias("reading_id"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    m = ifo.fit_isolation_forest(r, ["a", "b"], n_trees=20)
    roots = m.trees[m.trees["node_id"] == 0]
    assert len(roots) == 20 and set(roots["size"]) == {min(256, n)}


def test_scoring_moves_no_wide_rows(spark, fixture):
    feats = ["temperature", "vibration", "pressure"]
    m = ifo.fit_isolation_forest(fixture, feats, n_trees=5)
    plan = ifo.score_isolation_forest(m, fixture)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and "ArrowEvalPython" in plan


def test_serving_cleans_like_training(spark):
    """Gapped and out-of-range rows are scored from the same matrix that training built."""
    from vigil.operators import clean as cl
    from vigil.operators import features as feat
    from vigil.sources import views as v

    from conftest import SF001

    r = v.readings_gaps(spark, SF001).filter("reading_id < 3000")
    cleaned, stats = cl.fit_cleaning(r)
    models = pl.Models(pl.feature_set(), None, None, None, (0.0, 0.0), cl.CleaningStats.from_dict(stats.to_dict()))
    a = {x["reading_id"]: x for x in pl.aligned(feat.all_features(cleaned), models, keep=("reading_id",)).collect()}
    b = {x["reading_id"]: x for x in pl.aligned(pl.serving_features(r, models), models, keep=("reading_id",)).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k][f] - b[k][f]) <= 1e-9 * max(1.0, abs(a[k][f])) for k in a for f in pl.feature_set())
    assert a != {x["reading_id"]: x for x in pl.aligned(feat.all_features(r), models, keep=("reading_id",)).collect()}


def test_no_small_node_is_split_and_sql_scores_the_exported_nodes(spark):
    """M5's minimum split, and M6 recomputed by SQL from the exported node table."""
    import duckdb

    from vigil.models import classifiers as cls
    from vigil.models import metrics as mt
    from vigil.operators import explain as ex
    from vigil.operators import features as feat
    from vigil.sources import views as v

    names = ["temperature", "vibration", "pressure"]
    r = v.readings(spark, SF001).withColumn("y", feat.encode_label("label")).fillna(0.0, names)
    grown, cut = (cls.fit_forest(r, names, min_split=m, numTrees=10) for m in (0, 5))
    before, nodes = ex.forest_nodes(grown), ex.forest_nodes(cut)
    assert before[before.left >= 0].cover.min() < 5 <= nodes[nodes.left >= 0].cover.min()
    assert 0 < len(nodes) < len(before)
    for _, t in nodes.groupby("tree"):
        assert list(t.node) == list(range(len(t)))  # whole trees, numbered from the root
        inner = t[t.left >= 0]
        assert sorted([*inner.left, *inner.right]) == list(range(1, len(t)))
    scored = cls.predict_failure(cut, r)
    auc = [mt.auc(x, "failure_probability") for x in (cls.predict_failure(grown, r), scored)]
    assert abs(auc[0] - auc[1]) < 0.02
    rows, tree_nodes = r.select("reading_id", *names).toPandas(), nodes.rename(columns={"left": "l", "right": "r"})  # noqa: F841
    got = {x.reading_id: x.failure_probability for x in scored.select("reading_id", "failure_probability").collect()}
    want = duckdb.sql(f"""
        WITH RECURSIVE x AS (UNPIVOT (SELECT reading_id, {', '.join(f'{c} AS f{i}' for i, c in enumerate(names))} FROM rows) ON f0, f1, f2 INTO NAME f VALUE v),
        w AS (
            SELECT r.reading_id, n.tree, n.node, n.l, n.r, n.feature, n.threshold, n.value FROM rows r, tree_nodes n WHERE n.node = 0
            UNION ALL
            SELECT w.reading_id, n.tree, n.node, n.l, n.r, n.feature, n.threshold, n.value
            FROM w JOIN x ON x.reading_id = w.reading_id AND x.f = 'f' || w.feature
            JOIN tree_nodes n ON n.tree = w.tree AND n.node = CASE WHEN x.v <= w.threshold THEN w.l ELSE w.r END
            WHERE w.l >= 0)
        SELECT reading_id, avg(value) AS p FROM w WHERE l < 0 GROUP BY reading_id""").fetchall()
    assert len(want) == len(got)
    assert max(abs(got[k] - p) for k, p in want) < 1e-9


def test_training_partitions_are_bounded_by_rows(spark):
    from vigil.session import stored_by_rows

    df = spark.range(0, 1000, 1, 2).selectExpr("id AS reading_id", "id % 7 = 0 AS is_test")
    got = stored_by_rows(df, 100, "rows")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == 1000 and got.filter("is_test").count() == 143
    assert str(1 << 30) not in {s.conf.get("spark.sql.files.openCostInBytes") for s in (spark, SparkSession.getActiveSession())}


def test_training_table_is_cut_by_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pl, "TRAINING_ROWS", 150)
    monkeypatch.setattr(pl.cls, "fit_forest", lambda train, *a, **k: seen.append(train) or (_ for _ in ()).throw(RuntimeError("enough")))
    with pytest.raises(RuntimeError, match="enough"):
        pl.train_all(v.readings(spark, SF0001), ["temperature", "vibration"], n_trees=2)
    assert max(r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()) <= 150


def test_forest_and_logistic_never_hold_the_training_rows_at_once(spark, monkeypatch):
    ended, seen, fit = [], [], pl.cls.fit_logistic
    monkeypatch.setattr(pl.cls, "fit_logistic", lambda *a, **k: (fit(*a, **k), ended.append(1))[0])
    monkeypatch.setattr(pl.cls, "fit_forest", lambda *a, **k: seen.append(len(ended)) or (_ for _ in ()).throw(RuntimeError("enough")))
    r = spark.range(400).selectExpr(
        "id AS reading_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS timestamp", "'s' || id % 3 AS sensor_id",
        "CAST(id * 37 % 101 AS DOUBLE) AS temperature", "CAST(id * 11 % 13 AS DOUBLE) AS vibration", "if(id % 5 = 0, 'failure', 'normal') AS label")
    with pytest.raises(RuntimeError, match="enough"):
        pl.train_all(r, ["temperature", "vibration"], n_trees=2, do_clean=False)
    assert seen == [1]  # logistic fits that had ended when the forest began


def test_isolation_sample_and_paths_equal_the_plain_forms(spark):
    x = spark.range(300).selectExpr("id AS reading_id", "CAST(id * 37 % 101 AS DOUBLE) AS a", "CAST(id * 11 % 13 AS DOUBLE) AS b")
    got = {(r.tree_id, r._id) for r in ifo._sample(x, ["a", "b"], 300, 5, 16, 42, "reading_id").collect()}
    keep = int(4 * 16 / 300 * (1 << 32))
    drawn = x.select("reading_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("t")).select(
        "reading_id", "t", F.pmod(F.xxhash64(F.lit(42), "t", "reading_id"), F.lit(1 << 32)).alias("u"), F.xxhash64(F.lit(43), "t", "reading_id").alias("o")).collect()
    want = set()
    for t in range(5):
        want |= {(t, r.reading_id) for r in sorted((r for r in drawn if r.t == t and r.u < keep), key=lambda r: (r.o, r.reading_id))[:16]}
    assert got == want
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 2))
    trees = []
    for _ in range(4):
        a = np.asarray(ifo._grow(m[rng.choice(200, 32)], rng, 5), dtype=object)
        trees.append(tuple(a[:, k].astype(float if k == 1 else "int32") for k in range(5)))
    def path(row):
        total = 0.0
        for feat, thr, left, right, size in trees:
            node = depth = 0
            while feat[node] >= 0:
                node, depth = (left if row[feat[node]] < thr[node] else right)[node], depth + 1
            total += depth + float(ifo.c_factor(size[node]))
        return total / 4
    assert np.allclose(ifo._path_lengths(trees, m), [path(r) for r in m], rtol=0, atol=1e-12)


def test_the_forest_keeps_no_training_rows(spark, monkeypatch):
    """Spark ML's forest, which keeps 2 kB of each row, is never given the training rows."""
    from vigil.models import classifiers as cls

    given, fit = [], cls.RandomForestClassifier.fit
    monkeypatch.setattr(cls.RandomForestClassifier, "fit", lambda self, df, *a: given.append(df.count()) or fit(self, df, *a))
    df = spark.range(3000).selectExpr("CAST(id * 37 % 101 AS DOUBLE) AS a", "CAST(id * 11 % 13 AS DOUBLE) AS b", "CAST(id % 5 = 0 AS DOUBLE) AS y")
    model = cls.fit_forest(df, ["a", "b"], numTrees=4, maxDepth=5)
    assert max(given) <= 64 and model.stages[-1].getNumTrees == 4
    with pytest.raises(ValueError, match="labelled 0 or 1"):
        cls.fit_forest(df.withColumn("y", F.lit(None).cast("double")), ["a", "b"])


def test_forest_nodes_hold_the_rows_that_reach_them(spark):
    """Every node's counts are those of the bagged rows that its decisions lead to, and its split has the best Gini gain."""
    from vigil.models import forest as fo

    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=900), rng.integers(0, 4, 900), rng.normal(size=900)], 1)
    x[::50, 2] = np.nan
    y = ((x[:, 0] + x[:, 1] > 1.5) ^ (rng.random(900) < 0.1)).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(k)) for r, k in zip(x, y)], "a double, b double, c double, y double").repartition(3)
    nodes = fo.grow(df, ["a", "b", "c"], "y", 3, 4, 7, "all")
    points = [fo.split_points(x[:, k]) for k in range(3)]
    rows = fo.binned(df, ["a", "b", "c"], "y", points, 3, 7).collect()
    bins, bag, label = (np.array(v) for v in ([list(r.x) for r in rows], [list(r.bag) for r in rows], [r.y for r in rows]))
    assert 0.9 < bag.mean() < 1.1

    def counts(keep, w):
        return np.array([w[keep & (label == k)].sum() for k in (0, 1)], dtype=float)

    def gini(n):
        return 1 - ((n / n.sum()) ** 2).sum() if n.sum() else 0.0

    inner = 0
    for t, tree in nodes.groupby("treeID"):
        tree, w = tree.set_index("id"), bag[:, t].astype(float)
        stack = [(0, np.ones(len(rows), dtype=bool))]
        while stack:
            i, at = stack.pop()
            n = counts(at, w)
            assert list(tree.impurityStats[i]) == list(n) and tree.prediction[i] == float(n[1] > n[0])
            if tree.leftChild[i] < 0:
                continue
            inner += 1
            gains = []
            for f in range(3):
                for b in range(len(points[f])):
                    l, r = counts(at & (bins[:, f] <= b), w), counts(at & (bins[:, f] > b), w)
                    if l.sum() and r.sum():
                        gains.append((gini(n) - l.sum() / n.sum() * gini(l) - r.sum() / n.sum() * gini(r), f, points[f][b]))
            f, at_value = tree.featureIndex[i], tree.threshold[i][0]
            assert abs(tree.gain[i] - max(gains)[0]) < 1e-12 and any(abs(g - max(gains)[0]) < 1e-12 and (f, at_value) == (k, v) for g, k, v in gains)
            goes_left = bins[:, f] <= np.flatnonzero(points[f] == at_value)[0]
            stack += [(tree.leftChild[i], at & goes_left), (tree.rightChild[i], at & ~goes_left)]
    assert inner > 10


def test_split_points_lie_between_values():
    from vigil.models.forest import split_points

    assert split_points(np.array([3.0, 1.0, 1.0, np.nan, 2.0])).tolist() == [1.5, 2.5]
    assert split_points(np.array([4.0, 4.0])).tolist() == []
    many = split_points(np.arange(10_000.0))
    assert len(many) == 31 and np.ptp(np.diff(many)) <= 1
    tied = split_points(np.array([0.0] * 5000 + list(range(1, 5001))))  # a value with half of the rows
    assert len(tied) <= 31 and tied[0] == 0.5


def test_accuracy_and_auc_read_stored_predictions(spark, fixture, monkeypatch):
    plans, auc = [], mt.auc
    monkeypatch.setattr(mt, "auc", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or auc(df, *a))
    pl.train_all(fixture, pl.feature_set("basic6"), n_trees=2, forest_kw={"numTrees": 2, "maxDepth": 2})
    assert len(plans) == 2 and not any("UDF" in p for p in plans)


def test_wide_rows_pass_through_methods_that_are_compiled(spark):
    from vigil.session import ship_package

    ship_package(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
