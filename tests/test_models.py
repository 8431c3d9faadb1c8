from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from busvitals.functions import fixed_values as fv
from busvitals.operators import evaluate as ev, forest, kernel, neighbors, oneclass, projections, vantage

KEY = ["vehicle_id", "capture", "w"]


def windows(spark, n_normal=400, n_attack=60, seed=1, shift=4.0):
    rng = np.random.default_rng(seed)
    rows = []
    for capture, n, offset in (("Normal", n_normal, 0.0), ("DoS", n_attack, shift)):
        for i, x in enumerate(rng.normal(size=(n, 13)) + offset):
            rows.append(("v", i, *map(float, x), int(capture != "Normal"), capture, 50, capture))
    fields = ", ".join(f"{c} double" for c in fv.FEATURES)
    return spark.createDataFrame(rows, f"vehicle_id string, w bigint, {fields}, attack_label int, attack_type string, n_frames bigint, capture string")


@pytest.fixture(scope="module")
def data(spark):
    return windows(spark).persist()


@pytest.mark.parametrize("sizes", [{}, {"rows_per_ring": 20, "block_train": 15, "block_query": 25}])
def test_neighbours_equal_brute_force(spark, sizes):
    """Clusters, copies and far points; small blocks force every kind of cut."""
    rng = np.random.default_rng(3)
    base = np.concatenate([rng.normal(size=(120, 13)), rng.normal(size=(60, 13)) * 0.01 + 6, np.zeros((30, 13)), rng.normal(size=(5, 13)) * 50])
    names = [f"p{i:03d}" for i in range(len(base))]
    points = spark.createDataFrame([(n, [float(v) for v in x]) for n, x in zip(names, base)], "pid string, x array<double>")
    train = points.where("pid < 'p150' OR pid >= 'p180'")
    got: dict = {}
    for r in neighbors.knn_join(points, train, 7, **sizes).collect():
        got.setdefault(r["pid"], []).append((r["rank"], r["distance"], r["neighbour"]))
    idx = [i for i, n in enumerate(names) if n < "p150" or n >= "p180"]
    for i, n in enumerate(names):
        d = sorted((float(np.sqrt(((base[i] - base[j]) ** 2).sum())), names[j]) for j in idx if j != i)[:7]
        mine = sorted(got[n])
        assert [m[2] for m in mine] == [x[1] for x in d], n
        assert np.allclose([m[1] for m in mine], [x[0] for x in d])


def test_fewer_train_rows_than_k(spark):
    points = spark.createDataFrame([(f"p{i}", [float(i)] * 13) for i in range(4)], "pid string, x array<double>")
    got = neighbors.knn_join(points, points.limit(4), 20).groupBy("pid").count().collect()
    assert {r["count"] for r in got} == {3}


def test_neighbour_blocks_do_not_multiply_the_queries(spark, monkeypatch):
    """Rows in 13 dimensions: nearly all rings are within reach, so a query row is copied for each of them."""
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(f"p{i:05d}", [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(3_000, 13)))], "pid string, x array<double>").persist()
    copies = []
    exploded = type(points).withColumn

    def counted(df, name, column):
        out = exploded(df, name, column)
        if name == "ring" and "dist" not in df.columns:
            copies.append(out.count())
        return out

    monkeypatch.setattr(type(points), "withColumn", counted)
    got = neighbors.knn_join(points.where("pid < 'p00050'"), points, 20)
    assert copies == [50] and got.count() == 1_000


def test_neighbours_of_repeated_names_and_equal_points(spark):
    """Equal points are ranked by name; a name of several rows is left out with all of them."""
    rng = np.random.default_rng(6)
    base = [(f"p{i:03d}", [float(v) for v in x]) for i, x in enumerate(np.concatenate([np.zeros((300, 13)), rng.normal(size=(60, 13))]))]
    base += [("p003", [0.0] * 13)] * 5 + [("p310", [0.5] * 13)]
    points = spark.createDataFrame(base, "pid string, x array<double>")
    asked = [("p003", [0.0] * 13), ("p310", base[310][1]), ("q", [0.1] * 13)]
    for r in (rows := neighbors.knn_join(spark.createDataFrame(asked, "pid string, x array<double>"), points, 7).collect()):
        assert r["pid"] != r["neighbour"]
    for pid, x in asked:
        want = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), n) for n, y in base if n != pid)[:7]
        mine = sorted((r["rank"], r["neighbour"]) for r in rows if r["pid"] == pid)
        assert [n for _, n in mine] == [n for _, n in want]


def test_outlier_factor_is_high_outside(data):
    lof = vantage.lof_score(data, vantage.fit_lof(data)).select(*KEY, "lof").join(data.select(*KEY, "attack_label"), KEY)
    by = {r["attack_label"]: r["m"] for r in lof.groupBy("attack_label").agg(F.avg("lof").alias("m")).collect()}
    assert 0.9 < by[0] < 1.2 and by[1] > 1.5
    assert lof.count() == 460


def test_kernel_score_equals_direct_sum(data, spark, tmp_path):
    model = kernel.fit_parzen(data)
    kernel.save_model(spark, model, str(tmp_path / "m"))
    loaded = kernel.load_model(spark, str(tmp_path / "m"))
    rows = kernel.rbf_score(data, loaded).collect()
    x = (np.array([[r[c] for c in fv.FEATURES] for r in rows]) - model.mean) / model.std
    want = np.exp(-model.gamma * ((x[:, None] - model.support[None]) ** 2).sum(axis=2)).mean(axis=1) - model.rho
    assert np.allclose([r["anomaly_score"] for r in rows], want, atol=1e-12)
    normal = np.array([r["anomaly_score"] for r in rows if r["attack_label"] == 0])
    assert abs((normal < 0).mean() - 0.05) < 0.01


def test_incomplete_windows_score_null(data):
    holed = data.withColumn("messages_per_second", F.when(F.col("w") == 3, None).otherwise(F.col("messages_per_second")))
    model = kernel.fit_parzen(holed)
    assert kernel.rbf_score(holed, model).where("anomaly_score IS NULL").count() == 2
    forest_scores = forest.isolation_forest(holed, KEY)
    assert forest_scores.where("forest_score IS NULL").count() == 2


def test_model_size_is_bounded():
    with pytest.raises(ValueError):
        kernel.KernelModel(np.zeros(13), np.ones(13), np.zeros((5001, 13)), np.zeros(5001), 1.0, 0.0)


def test_forest_separates_and_does_not_depend_on_partitions(data):
    a = forest.isolation_forest(data.repartition(1), KEY).select(*KEY, F.round("forest_score", 12))
    b = forest.isolation_forest(data.repartition(9), KEY).select(*KEY, F.round("forest_score", 12))
    assert a.exceptAll(b).count() == 0
    auc = ev.roc_auc(forest.isolation_forest(data, KEY), "forest_score").first()["auc"]
    assert auc > 0.95
    nodes = forest.fit_forest(data.where("attack_label = 0"), KEY)
    per_tree = nodes.groupBy("tree").count().collect()
    assert len(per_tree) == forest.TREES and max(r["count"] for r in per_tree) < 2 * forest.SAMPLE


def test_one_class_machine(data):
    model = oneclass.ocsvm_fit(data)
    scored = oneclass.ocsvm_score(data, model)
    share = scored.where("attack_label = 0").agg(F.avg((F.col("ocsvm_score") < 0).cast("int"))).first()[0]
    assert share <= oneclass.NU + 0.005
    assert ev.roc_auc(scored, "ocsvm_score").first()["auc"] > 0.95


def test_quality_numbers_by_hand(spark):
    rows = [("v", "x", i, s, y, "A" if y else "Normal", int(s < 0.4)) for i, (s, y) in enumerate(
        [(0.1, 1), (0.2, 1), (0.3, 0), (0.3, 1), (0.5, 0), (0.6, 1), (0.9, 0), (0.9, 0)])]
    df = spark.createDataFrame(rows, "vehicle_id string, capture string, w int, anomaly_score double, attack_label int, attack_type string, is_anomaly int")
    assert tuple(ev.confusion_matrix(df).first()) == (3, 1, 1, 3)
    m = ev.classification_metrics(df).first()
    assert (m["precision"], m["recall"], m["f1"], m["fpr"]) == (0.75, 0.75, 0.75, 0.25)
    wins = sum(1.0 if p[3] < n[3] else 0.5 if p[3] == n[3] else 0.0 for p in rows for n in rows if p[4] == 1 and n[4] == 0)
    assert ev.roc_auc(df).first()["auc"] == pytest.approx(wins / 16)
    assert ev.average_precision(df).first()[0] == pytest.approx(0.25 * 1 + 0.25 * 1 + 0.25 * 3 / 4 + 0.25 * 4 / 6)
    one_class = df.where("attack_label = 0")
    assert ev.roc_auc(one_class).first()["auc"] == 0.0
    assert ev.classification_metrics(one_class).first()["precision"] == 0.0


@pytest.mark.parametrize("leaf,k", [(4, 3), (16, 20), (1000, 7)])
def test_vantage_tree_equals_brute_force(leaf, k):
    """Clusters, copies, ties, far points, and queries that are points themselves."""
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(size=(150, 5)), np.zeros((40, 5)), rng.integers(0, 2, size=(80, 5)).astype(float), rng.normal(size=(9, 5)) * 100])
    asked = np.concatenate([points, rng.normal(size=(60, 5)), np.full((1, 5), 1e6)])
    itself = np.concatenate([np.arange(len(points)), np.full(61, -1)])
    far, near = vantage.Tree.over(points, leaf).nearest(asked, k, itself)
    d = np.sqrt(((asked[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    d[np.arange(len(points)), np.arange(len(points))] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :k]
    assert np.allclose(far, np.take_along_axis(d, want, axis=1))
    assert (np.take_along_axis(d, near, axis=1) == np.take_along_axis(d, want, axis=1)).all() and (near == want).all()


def test_vantage_tree_leaves_out_what_is_far():
    """Well-parted clusters: a query looks at its own."""
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(size=(200, 13)) + 60 * c for c in range(20)])
    tree = vantage.Tree.over(points)
    seen = []
    looked = vantage._distances

    def counting(a, b):
        seen.append(len(a) * len(b))
        return looked(a, b)

    vantage._distances = counting
    try:
        tree.nearest(points[:500], 20)
    finally:
        vantage._distances = looked
    assert sum(seen) < 500 * len(points) / 5


def test_few_train_rows_and_missing_features(spark):
    few = windows(spark, 3, 2)
    got = {(r["capture"], r["w"]): r["lof"] for r in vantage.lof_score(few, vantage.fit_lof(few)).collect()}
    assert len(got) == 5 and all(v > 0 for v in got.values())
    one = windows(spark, 1, 2)
    got = {(r["capture"], r["w"]): r["lof"] for r in vantage.lof_score(one, vantage.fit_lof(one)).collect()}
    assert got[("Normal", 0)] is None  # no neighbour but itself
    holed = few.withColumn(fv.FEATURES[2], F.when(F.col("w") > 0, F.col(fv.FEATURES[2])))
    assert vantage.lof_score(holed, vantage.fit_lof(few)).where("lof IS NULL").count() == 2


def test_lof_is_narrow(data):
    scored = vantage.lof_score(data, vantage.fit_lof(data))
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString().replace("InMemoryRelation", "").split("InMemoryTableScan")[0]


def objective(weights, phi, nu):
    margins = phi @ weights
    rho = np.quantile(margins, nu)
    return weights @ weights / 2 - rho + np.maximum(0, rho - margins).mean() / nu


def test_one_class_blocks_agree_with_the_whole(spark):
    """Ten blocks, at most five passes; near the optimum of all rows, and better than many plain sub-gradient steps."""
    data = windows(spark, 3000, 10).persist()
    passes = []
    summed = oneclass._summed
    oneclass._summed = lambda *a: passes.append(1) or summed(*a)
    try:
        model = oneclass.ocsvm_fit(data, nu=0.05, block_rows=300)
    finally:
        oneclass._summed = summed
    assert 1 <= len(passes) <= 5
    rows = data.where("attack_label = 0").select(*fv.FEATURES).toPandas().to_numpy()
    phi = model.features(rows)
    whole = oneclass.minimum(phi, 0.05)
    best, got = objective(whole[:-1], phi, 0.05), objective(model.weights, phi, 0.05)
    w = phi.mean(axis=0)
    rho, mean = w @ w, 0.0
    for step in range(1, 201):
        below = phi @ w < rho
        rate = 0.5 / np.sqrt(step)
        w = w - rate * (w - phi[below].sum(axis=0) / (0.05 * len(phi)))
        rho -= rate * (below.sum() / (0.05 * len(phi)) - 1) * 0.01
        mean = mean + w / 200
    assert best <= got <= best + 0.02 * abs(best) + 1e-3 and got <= objective(mean, phi, 0.05)
    share = oneclass.ocsvm_score(data, model).where("attack_label = 0").agg(F.avg((F.col("ocsvm_score") < 0).cast("int"))).first()[0]
    assert abs(share - 0.05) <= 2 / 3000


def test_one_class_minimum_has_no_slope():
    """The optimum of a small problem: no step in any direction makes it better."""
    rng = np.random.default_rng(4)
    phi = rng.normal(size=(200, 6)) * 0.2 + 0.5
    x = oneclass.minimum(phi, 0.1)

    def value(x):
        z = np.maximum(0, x[-1] - phi @ x[:-1])
        return x[:-1] @ x[:-1] / 2 - x[-1] + z.mean() / 0.1

    assert all(value(x) <= value(x + step) + 1e-4 for step in rng.normal(size=(500, 7)) * rng.choice([0.3, 0.03, 0.003], size=(500, 1)))


def structured(n, seed):
    """Rows of 13 numbers that follow three hidden ones."""
    rng = np.random.default_rng(seed)
    return np.tanh(rng.normal(size=(n, 3)) @ np.random.default_rng(1).normal(size=(3, 13))) + 0.1 * rng.normal(size=(n, 13))


def recall_and_work(n, k=20, asked=150):
    x = structured(n, 2)
    tables = projections.Projections.fit(x[:2000], n)
    own, found, work = tables.own(x), 0, 0
    for i, codes in enumerate(tables.probed(x[:asked], projections.PROBES)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hit = np.isin(own, codes)
        work += hit.sum()
        found += hit.any(axis=1)[np.argpartition(d, k)[:k]].sum()
    return found / asked / k, work / asked


def test_projection_tables_find_most_with_less_and_less_work():
    small, large = recall_and_work(4_000), recall_and_work(32_000)
    assert small[0] >= 0.9 and large[0] >= 0.9
    assert large[1] < 0.3 * 32_000 and large[1] / small[1] < 0.75 * 8  # pairs for each query grow slower than the rows


@pytest.mark.parametrize("sizes", [{}, {"block_train": 30, "block_query": 40}])
def test_approximate_neighbours_against_the_exact_join(spark, sizes):
    """Clusters, one vector that a third of all rows share, and far points."""
    base = np.concatenate([structured(500, 3), np.zeros((300, 13)), structured(60, 4) * 0.01 + 6, structured(5, 5) * 50])
    points = spark.createDataFrame([(f"p{i:04d}", [float(v) for v in x]) for i, x in enumerate(base)], "pid string, x array<double>").persist()
    train = points.where("pid < 'p0700' OR pid >= 'p0810'")
    exact = {(r["pid"], r["neighbour"]): r["distance"] for r in neighbors.knn_join(points, train, 7).collect()}
    rows = projections.approximate_knn_join(points, train, 7, **sizes).collect()
    got = {(r["pid"], r["neighbour"]): r["distance"] for r in rows}
    assert len(got) == len(rows) and all(a != b for a, b in got)
    assert len(set(got) & set(exact)) >= 0.9 * len(exact)
    assert all(abs(exact[p] - got[p]) < 1e-9 for p in set(got) & set(exact))


def test_few_rows_are_joined_exactly(spark):
    points = spark.createDataFrame([(f"p{i}", [float(v) for v in x]) for i, x in enumerate(structured(90, 6))], "pid string, x array<double>").persist()
    key = lambda df: {(r["pid"], r["rank"], r["neighbour"]) for r in df.collect()}
    assert key(projections.approximate_knn_join(points, points, 5)) == key(neighbors.knn_join(points, points, 5))
