import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.errors import DimensionMismatch, InvalidParameter, MLError, NotFitted, NumericalInstability
from granary.functions import activation, metrics, surfaces, validation
from granary.plans import facade, kmeans, linear, logistic, network, optimizers, pca
from granary.streaming import incremental


def line(spark, f, xs):
    return spark.createDataFrame([(*x, float(f(*x))) for x in xs], ", ".join([*[f"x{i} double" for i in range(len(xs[0]))], "y double"]))


def test_linear_golden(spark):
    df = line(spark, lambda x: 2 * x + 1, [(float(i),) for i in range(1, 6)])
    m = linear.LinearRegression(0.01).fit(df, ["x0"], "y", 1000)
    assert m.weights[0] == pytest.approx(2.01, abs=0.05) and m.bias == pytest.approx(0.95, abs=0.1) and m.history[0] == pytest.approx(29.5, abs=3) and m.history[-1] < 0.01
    fixed = linear.LinearRegression(weights=np.array([2.0, 3.0]), bias=1.0, features=["a", "b"])
    assert fixed.predict_single([1.0, 2.0]) == 9.0
    y = spark.createDataFrame([(2.0, 1.0), (4.0, 3.0), (6.0, 5.0)], "y double, p double")
    assert y.agg(linear.cost("y", "p")).first()[0] == 0.5
    assert linear.LinearRegression(weights=np.array([1.5, -2.3, 0.8]), bias=-0.5, features=["x1", "x2", "x3"]).equation() == "y = 1.5000·x1 - 2.3000·x2 + 0.8000·x3 - 0.5000"
    assert linear.LinearRegression().equation() == "y = b"
    with pytest.raises(NotFitted):
        linear.LinearRegression().predict(df)
    with pytest.raises(DimensionMismatch, match="expected 1, got 2"):
        m.predict_single([1.0, 2.0])


def test_moments_descent_equals_row_descent(spark):
    rng = np.random.default_rng(0)
    x, w, b = rng.normal(size=(50, 2)), np.zeros(2), 0.0
    y = x @ [3.0, 2.0] + 1
    for _ in range(200):
        e = x @ w + b - y
        w, b = w - 0.1 * x.T @ e / 50, b - 0.1 * e.mean()
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, y double")
    m = linear.LinearRegression(0.1).fit(df, ["a", "b"], "y", 200)
    assert np.allclose(m.weights, w) and m.bias == pytest.approx(b)
    early = linear.LinearRegression(0.1).fit(df, ["a", "b"], "y", 1000, tolerance=1e-3)
    assert early.history[-1] < 1e-3 <= early.history[-2]
    more = linear.LinearRegression(0.1).fit(df, ["a", "b"], "y", 100).fit(df, ["a", "b"], "y", 100)
    assert np.allclose(more.weights, w) and len(more.history) == 200
    with pytest.raises(NumericalInstability):
        linear.LinearRegression(50.0).fit(df, ["a", "b"], "y", 500, strict=True)


def test_logistic(spark):
    rows = [(1.0, 2.0, 0), (2.0, 1.0, 0), (1.5, 1.5, 0), (6.0, 5.0, 1), (7.0, 7.0, 1), (6.5, 6.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    m = logistic.LogisticRegression(0.3, 60, 1e-6).fit(df, ["a", "b"], "y")
    assert [r.prediction for r in m.predict(df).collect()] == [0, 0, 0, 1, 1, 1]
    shifted = logistic.LogisticRegression(0.3, 60, 1e-6).fit(df.withColumn("y", F.col("y") + 1), ["a", "b"], "y")
    assert [r.prediction for r in shifted.predict(df).collect()] == [0, 0, 0, 1, 1, 1]
    three = spark.createDataFrame([(0.0, 0.0, 0), (0.5, 0.0, 0), (5.0, 0.0, 1), (5.5, 0.0, 1), (0.0, 5.0, 2), (0.5, 5.0, 2)], "a double, b double, y int")
    m3 = logistic.LogisticRegression(0.5, 60, 1e-6).fit(three, ["a", "b"], "y")
    out = m3.predict(m3.predict_proba(three)).collect()
    assert [r.prediction for r in out] == [0, 0, 1, 1, 2, 2] and all(sum(r.probabilities) == pytest.approx(1) for r in out)
    with pytest.raises(MLError, match="Need at least 2 classes"):
        logistic.LogisticRegression().fit(df.where("y = 0"), ["a", "b"], "y")
    with pytest.raises(InvalidParameter):
        logistic.LogisticRegression(learning_rate=0)


def packed(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "row_id int, features array<double>")


@pytest.mark.parametrize(("l1", "l2", "parts"), [(0.0, 0.0, 1), (0.01, 0.0, 2), (0.0, 0.1, 3), (0.01, 0.05, 2)])
def test_minibatches_equal_numpy_at_any_partitioning(spark, l1, l2, parts):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 4)), rng.uniform(0, 1, (60, 2))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "row_id long, x array<double>, y array<double>")
    new = lambda: network.Network([4, 5, 2], ["tanh", "sigmoid"], 0.4, seed=2)
    want, steps, losses = new(), 5, []
    for k in range(steps):
        rows = np.arange(60) % parts == k % parts
        grads = [want.gradients(a, b) for a, b in zip(x[rows], y[rows])]
        losses.append(np.mean([g[2] for g in grads]))
        for j in range(2):
            w = want.weights[j] - 0.4 * (np.mean([g[0][j] for g in grads], axis=0) + l2 * want.weights[j])
            want.weights[j] = np.sign(w) * np.maximum(np.abs(w) - 0.4 * l1, 0)
            want.biases[j] = want.biases[j] - 0.4 * np.mean([g[1][j] for g in grads], axis=0)
    for n in (1, 8):
        got = new().fit_minibatch(df.repartition(n), "x", "y", steps, parts, F.col("row_id"), l1, l2)
        assert np.allclose(got._flat(), want._flat(), atol=1e-12) and np.allclose(got.history["loss"], losses)
        assert got.table(spark).count() == len(got._flat())


def test_minibatches_of_odd_rows(spark):
    df = spark.createDataFrame([([1.0], [1.0]), (None, [1.0]), ([2.0], None)], "x array<double>, y array<double>")
    net = network.Network([1, 1], ["linear"], 0.1, weights=[np.zeros((1, 1))], biases=[np.zeros(1)])
    assert np.allclose(net.fit_minibatch(df, "x", "y", 1)._flat(), [0.1, 0.1])
    assert np.allclose(net.fit_minibatch(df.limit(0), "x", "y", 2)._flat(), [0.1, 0.1]) and not len(net.history)
    with pytest.raises(DimensionMismatch):
        net.fit_minibatch(spark.createDataFrame([([1.0, 2.0], [1.0])], df.schema), "x", "y", 1)
    with pytest.raises(InvalidParameter):
        net.fit_minibatch(df, "x", "y", 1, parts=0)


def test_a_number_is_no_class(spark, monkeypatch):
    monkeypatch.setattr(logistic, "MOST_LABELS", 5)
    df = spark.range(6).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y")
    with pytest.raises(MLError, match="5 distinct labels"):
        logistic.LogisticRegression().fit(df, ["x"], "y")


def test_scalable_start_takes_as_many_jobs_for_any_k_and_is_no_worse(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.1, (60, 3)) for c in rng.uniform(-5, 5, (12, 3))])
    df = packed(spark, x.tolist()).repartition(3).persist()
    jobs = {}
    for k in (3, 12):
        spark.sparkContext.setJobGroup(f"start {k}", "")
        assert kmeans.KMeans(k, seed=5).initialize_scalable(df).shape == (k, 3)  # the first run also fills the cache
        jobs[k] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"start {k}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[12] <= jobs[3] <= 30
    one, two = (kmeans.KMeans(12, 10, seed=5, start=s).fit(df).inertia for s in ("scalable", "plus_plus"))
    assert one <= 1.05 * two
    same = packed(spark, [(1.0, 2.0)] * 5)
    assert kmeans.KMeans(3, seed=1).initialize_scalable(same).tolist() == [[1, 2]] * 3


def test_kmeans(spark):
    df = packed(spark, [(1, 1), (1.5, 2), (1, 0), (10, 10), (10.5, 11), (9, 10)])
    m = kmeans.KMeans(2, seed=7)
    labels = [r.label for r in m.fit_predict(df).orderBy("row_id").collect()]
    assert len(set(labels[:3])) == 1 and len(set(labels[3:])) == 1 and labels[0] != labels[3] and m.n_iterations < 100
    empty = kmeans.KMeans(2, 1).fit(df, [[5, 5], [1000, 1000]])
    assert empty.centroids[1].tolist() == [0, 0]
    assert kmeans.KMeans(1).fit(packed(spark, [(1, 2), (3, 4), (5, 6)])).centroids.tolist() == [[3, 4]]
    assert kmeans.KMeans(2).fit(packed(spark, [(1, 1)] * 4)).inertia == 0
    with pytest.raises(MLError, match=r"Number of samples \(1\) must be >= n_clusters \(2\)"):
        kmeans.KMeans(2).fit(packed(spark, [(1, 1)]))
    with pytest.raises(InvalidParameter):
        kmeans.KMeans(0)


def test_pca(spark):
    df = spark.createDataFrame([(2.5, 2.4), (0.5, 0.7), (2.2, 2.9), (1.9, 2.2), (3.1, 3.0), (2.3, 2.7)], "a double, b double")
    m = pca.PCA(2).fit(df, ["a", "b"])
    assert m.explained_variance_ratio().sum() == pytest.approx(1) and m.explained_variance[0] > m.explained_variance[1] and np.linalg.norm(m.components[0]) == pytest.approx(1)
    out = m.transform(df).agg(F.avg("pc1"), F.var_samp("pc1")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(m.explained_variance[0])
    opposite = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)], "a double, b double")
    assert pca.PCA(1).fit(opposite, ["a", "b"]).explained_variance[0] == pytest.approx(2)
    with pytest.raises(MLError, match="Could only find 1 significant components"):
        pca.PCA(2).fit(opposite, ["a", "b"])
    with pytest.raises(MLError, match=r"n_components \(3\) cannot exceed n_features \(2\)"):
        pca.PCA(3).fit(df, ["a", "b"])
    with pytest.raises(MLError, match="Need at least 2 samples"):
        pca.PCA(1).fit(df.limit(1), ["a", "b"])


@pytest.mark.parametrize("prices", [[1.0, 2.0, 3.0, 5.0], [5.0, 3.0, 2.0, 1.0], [1.0, -1.0, -1.0, 1.0]])
def test_two_column_queries_put_the_sum_first(spark, tmp_path, prices):
    """Correlations above, under and at zero: the component that is the sum is the first one, as in the SQL."""
    from granary import queries

    x = [1.0, 1.0, -1.0, -1.0] if prices[0] == prices[3] else [1.0, 2.0, 3.5, 4.0]
    rows = [(i, 1, a, b) for i, (a, b) in enumerate(zip(x, prices))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    r = np.corrcoef(x, prices)[0, 1]
    h = 0.5**0.5
    got = {(c, f): (v, e) for c, f, v, e, _ in queries.QUERIES["pca01_two_columns"](spark, str(tmp_path)).collect()}
    want = {(1, "l_quantity"): (h, 1 + r), (1, "l_extendedprice"): (h, 1 + r), (2, "l_quantity"): (h, 1 - r), (2, "l_extendedprice"): (-h, 1 - r)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    z = [(np.array(c) - np.mean(c)) / np.std(c, ddof=1) for c in (x, prices)]
    out = {q.l_orderkey: (q.pc1, q.pc2) for q in queries.QUERIES["pca02_two_columns"](spark, str(tmp_path)).collect()}
    assert all(out[i] == pytest.approx(((a + b) * h, (a - b) * h), abs=1e-4) for i, (a, b) in enumerate(zip(*z)))


def test_network(spark):
    xor = spark.createDataFrame([(0, [0.0, 0.0], [0.0]), (1, [0.0, 1.0], [1.0]), (2, [1.0, 0.0], [1.0]), (3, [1.0, 1.0], [0.0])], "row_id int, features array<double>, y array<double>")
    net = network.Network([2, 4, 1], ["tanh", "sigmoid"], 0.5, seed=3)
    same = network.Network([2, 4, 1], ["tanh", "sigmoid"], 0.5, seed=3)
    net.fit(xor.repartition(3), "features", "y", "row_id", 1500, snapshot_every=500)
    x, y = np.array([[0, 0], [0, 1], [1, 0], [1, 1.0]]), np.array([[0], [1], [1], [0.0]])
    for _ in range(1500):
        same.train_epoch(x, y)
    assert all(np.allclose(a, b) for a, b in zip(net.weights, same.weights))
    got = [r.output[0] for r in net.predict(xor).orderBy("row_id").collect()]
    assert got[0] < 0.3 and got[1] > 0.7 and got[2] > 0.7 and got[3] < 0.3
    assert np.allclose(got, same.forward(x)[1][-1].ravel()) and net.history.accuracy.iloc[-1] == 100
    assert network.mse_loss([0.9, 0.2, 0.1], [1.0, 0.1, 0.1]) == pytest.approx(0.0066667, abs=1e-6)
    a, b = network.Network([2, 3, 1], ["relu", "linear"], 0.05, seed=1), network.Network([2, 3, 1], ["relu", "linear"], 0.05, seed=1)
    a.fit_minibatch(xor.repartition(1), "features", "y", 5)
    b.fit_minibatch(xor.repartition(4), "features", "y", 5)
    assert all(np.allclose(u, v) for u, v in zip(a.weights, b.weights))
    g, _, _ = same.gradients(x[1], y[1])
    eps = 1e-6
    same.weights[0][0, 1] += eps
    up = float(((same.forward(x[1])[1][-1] - y[1]) ** 2).sum() / 2)
    same.weights[0][0, 1] -= 2 * eps
    assert (up - float(((same.forward(x[1])[1][-1] - y[1]) ** 2).sum() / 2)) / (2 * eps) == pytest.approx(g[0][0, 1], abs=1e-5)
    with pytest.raises(InvalidParameter):
        network.Network([2], [])


@pytest.mark.parametrize("name", activation.NAMES)
def test_activations(spark, name):
    z = np.array([-2.0, 0.0, 0.5, 3.0])
    df = spark.createDataFrame([(float(v),) for v in z], "z double")
    got = df.select(activation.activate(name, F.col("z")), activation.derivative(name, F.col("z"))).collect()
    assert np.allclose([g[0] for g in got], activation.np_activate(name, z)) and np.allclose([g[1] for g in got], activation.np_derivative(name, z))


def test_initializers():
    rng = np.random.default_rng(0)
    assert np.abs(activation.initialize("xavier", 4, 2, rng)).max() <= 1 and not activation.initialize("zeros", 3, 3, rng).any()
    with pytest.raises(InvalidParameter):
        activation.initialize("x", 1, 1, rng)


def test_optimizer_steps():
    assert optimizers.Optimizer("SGD", 0.1).update("x", 1.0, 2.0) == pytest.approx(0.8)
    assert np.allclose(optimizers.Optimizer("SGD", 0.1).update("b", np.array([1.0, 2.0, 3.0]), np.array([0.5, 1.0, 1.5])), [0.95, 1.9, 2.85])
    legacy, fixed = optimizers.Optimizer("Adam", 0.1, legacy_timestep=True), optimizers.Optimizer("Adam", 0.1)
    fixed.tick()
    for o in (legacy, fixed):
        for layer in range(2):
            o.update(layer, np.zeros(2), np.ones(2))
    assert legacy.t == 2 and fixed.t == 1
    for bad in ({"kind": "SGD", "learning_rate": 0}, {"kind": "Adam", "learning_rate": 1, "beta1": 1}, {"kind": "x", "learning_rate": 1}, {"kind": "SGD", "learning_rate": 1, "epsilon": 0}):
        with pytest.raises(InvalidParameter):
            optimizers.Optimizer(**bad)


def test_race_equals_a_loop(spark):
    final = {r.optimizer: r for r in optimizers.ranking(optimizers.finals(optimizers.race(spark, "Rosenbrock", 0.001), 100)).collect()}
    for kind, betas in (("SGD", {}), ("Momentum", {}), ("RMSprop", {"beta2": 0.9}), ("Adam", {})):
        o, x, y = optimizers.Optimizer(kind, 0.001, **betas), -1.0, 1.0
        for _ in range(100):
            x, y = o.step_2d(x, y, *surfaces.gradient("Rosenbrock", x, y))
        assert (final[kind].x, final[kind].y) == (pytest.approx(x, abs=1e-10), pytest.approx(y, abs=1e-10))
    assert sorted(r["rank"] for r in final.values()) == [1, 2, 3, 4]
    t = optimizers.trajectories(optimizers.race(spark, "Quadratic", 0.1), 200).where("optimizer = 'SGD'").orderBy("iter").collect()
    assert t[-1].converged and t[-1].loss < 1e-6 and len(t) < 200
    saddle = optimizers.winner(optimizers.finals(optimizers.race(spark, "Saddle", 0.1), 50)).first()
    assert saddle.has_winner
    demo = optimizers.trajectories(optimizers.demo(spark, "Quadratic"), 20, rule="gradient")
    assert demo.count() == 80


@pytest.mark.parametrize("name", surfaces.NAMES)
def test_gradients_by_differences(spark, name):
    x, y, h = 0.5, 0.3, 1e-6
    gx, gy = surfaces.gradient(name, x, y)
    assert gx == pytest.approx((surfaces.value(name, x + h, y) - surfaces.value(name, x - h, y)) / (2 * h), abs=1e-4)
    assert gy == pytest.approx((surfaces.value(name, x, y + h) - surfaces.value(name, x, y - h)) / (2 * h), abs=1e-4)
    for m in next(s[5] for s in surfaces.SURFACES if s[0] == name):
        assert np.hypot(*surfaces.gradient(name, *m)) < 1e-3
    df = spark.createDataFrame([(x, y)], "x double, y double")
    assert df.select(surfaces.value(name, F.col("x"), F.col("y"))).first()[0] == pytest.approx(surfaces.value(name, x, y))


def test_heatmap_and_colors(spark):
    rows = surfaces.heatmap(spark, "Quadratic", 3).collect()
    assert len(rows) == 9 and min(r.t for r in rows) == 0 and max(r.t for r in rows) == 1
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "v double")
    assert [r.t for r in surfaces.heat(df).collect()][0] == 1.0
    assert spark.range(1).select(surfaces.heat_color(F.lit(0.0)), surfaces.correlation_color(F.lit(-1.0))).first()[:] == ("hsl(240, 80%, 30%)", "rgb(0,0,255)")


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (1, 1), (1, 0), (0, 0)], "y int, p int")
    assert tuple(df.agg(metrics.accuracy("y", "p"), metrics.precision("y", "p", 1), metrics.recall("y", "p", 1), metrics.f1("y", "p", 1)).first()) == (0.8, 1.0, pytest.approx(2 / 3), pytest.approx(0.8))
    none = df.where("false").agg(metrics.mse("y", "p"), metrics.precision("y", "p", 1), metrics.r2("y", "p")).first()
    assert tuple(none) == (None, 0.0, None) and df.agg(metrics.r2("y", "y")).first()[0] == 1.0 and df.where("y = 1").agg(metrics.r2("y", "p")).first()[0] is None


def test_validation_and_config(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(validation.learning_rate(F.lit("20")))["state"] == "Warning" and one(validation.is_valid(validation.learning_rate(F.lit("20"))))
    assert validation.csv_file_size(6 << 20)[0] == "Invalid" and validation.csv_dimensions(5, 2)[0] == "Warning" and validation.csv_dimensions(100, 2)[0] == "Valid"
    assert validation.defaults("KMeans", "aggressive")["n_clusters"] == 8 and validation.defaults("LinearRegression", "conservative")["learning_rate"] == 0.001
    assert validation.Parameter("k", 3, 2, 20).validate(1)[0] == "Invalid" and validation.Parameter("k", 3, whole=True).convert("3.9") == 3
    assert validation.guarded(lambda: 1 / 0)[1].startswith("ZeroDivisionError") and validation.guarded(int, "3") == (3, None)
    p = one(validation.progress(F.lit(50), F.lit(100), F.lit(1.0), F.lit(0.3), F.lit(5000.0)))
    assert (p.progress_pct, p.improvement_pct, p.eta_ms) == (50, pytest.approx(70), 5000) and one(validation.format_time(F.lit(65000))) == "1m 5s"
    for bad in ({"rows": 0, "cols": 1}, {"rows": 2, "cols": 1, "k": 3}, {"rows": 2, "cols": 1, "iterations": 0}, {"rows": 2, "cols": 1, "rate": 11}):
        with pytest.raises(InvalidParameter):
            validation.algorithm_input(**bad)


def test_facade(spark):
    df = spark.createDataFrame([(float(i), float(i % 5), float(i > 10)) for i in range(20)], "a double, b double, y double")
    for name in ("KMeans", "PCA", "LinearRegression", "LogisticRegression", "StandardScaler", "MinMaxScaler", "RobustScaler"):
        out = facade.run(name, df, ["a", "b"], "y", **({"max_iterations": 20} if name in ("LinearRegression", "LogisticRegression") else {}))
        assert out.result.count() == 20
    with pytest.raises(InvalidParameter):
        facade.run("KMeans", df, ["a"], n_clusters=30)


def test_incremental(spark, tmp_path):
    df = line(spark, lambda x, z: 3 * x - z + 2, [(float(i % 7) / 7, float(i % 5) / 5) for i in range(200)])
    whole = incremental.IncrementalLinear(["x0", "x1"], "y", 0.5, 300).partial_fit(df)
    parts = incremental.IncrementalLinear(["x0", "x1"], "y", 0.5, 300)
    for i, p in enumerate(df.randomSplit([0.3, 0.7], 1)):
        parts.partial_fit(p, i).partial_fit(p, i)
    assert parts.seen.n == 200 and np.allclose(parts.seen.products, whole.seen.products)
    df.write.parquet(str(tmp_path / "in"))
    m = incremental.IncrementalLinear(["x0", "x1"], "y", 0.5, 500)
    m.start(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "check")).awaitTermination()
    assert m.seen.n == 200 and m.model.weights[0] == pytest.approx(3, abs=0.1)
