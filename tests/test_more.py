"""More operators against plain versions: clusters, classifiers, systems, names, bits, files, settings."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainmill import context, scratch
from grainmill.errors import ArgumentStructureError, ArgumentValueError
from grainmill.functions import bits, geo, python_udfs
from grainmill.operators import checks, classify, clusters, coefficients, graph, names, ordered, regress, series
from grainmill.sources import files
from grainmill.streaming import pending, requests


def vectors(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.3, (n // 3, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<double>")


def test_kmeans_is_the_best_of_its_starts(spark):
    x, df = vectors(spark)
    model, rows = clusters.kmeans(df, "v", 3, n_init=4)
    got = rows.orderBy("k").toPandas()
    at = np.array([c for c in model.clusterCenters()])
    d = ((x[:, None] - at[None]) ** 2).sum(-1)
    assert (d.argmin(1) == got["cluster"]).all() and math.isclose(d.min(1).sum(), model.summary.trainingCost, rel_tol=1e-9)
    assert len({frozenset(got.k[got.cluster == c]) for c in range(3)} & {frozenset(range(a, a + 20)) for a in (0, 20, 40)}) == 3
    assert model.summary.trainingCost <= min(clusters.kmeans(df, "v", 3, seed=s, n_init=1)[0].summary.trainingCost for s in range(4)) + 1e-9


def test_search_scores_each_k(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 25)
    x, df = vectors(spark)
    got = {r.k: r for r in clusters.search_k(df, "k", "v", 5, n_init=2).collect()}
    assert set(got) == {2, 3, 4} and max(got, key=lambda k: got[k].score) == 3
    _, rows = clusters.kmeans(df, "v", 3, n_init=2)
    label = rows.orderBy("k").toPandas()["cluster"].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    plain = []
    for i in range(len(x)):
        mean = {c: d[i][(label == c) & (np.arange(len(x)) != i)].mean() for c in set(label)}
        a, b = mean.pop(label[i]), min(mean.values())
        plain.append((b - a) / max(a, b))
    assert math.isclose(got[3].score, np.mean(plain), rel_tol=1e-9)


def test_search_takes_each_distance_once(spark, monkeypatch):
    """All numbers of clusters are scored in one pass over the pairs, copies and far clusters included, by the plain silhouette's figures."""
    monkeypatch.setattr(clusters, "BLOCK", 25)
    x, _ = vectors(spark)
    x = np.concatenate([x, x[:9], x[:5] + 1e-7, x[20:24] + 1e6])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<double>")
    passes, plain = [], clusters.mean_silhouettes
    monkeypatch.setattr(clusters, "mean_silhouettes", lambda *a: passes.append(a[3]) or plain(*a))
    got = {r.k: r.score for r in clusters.search_k(df, "k", "v", 5, n_init=2).collect()}
    assert passes == [{"_k2": 2, "_k3": 3, "_k4": 4}]
    for k in got:
        _, rows = clusters.kmeans(df, "v", k, n_init=2)
        assert math.isclose(got[k], clusters.silhouette(rows, "k", "cluster", "v").agg(F.avg("silhouette")).first()[0], rel_tol=1e-7)
    same = spark.createDataFrame([(k, [3.0, 4.0]) for k in range(30)], "k int, v array<double>")
    assert [r.score for r in clusters.search_k(same, "k", "v", 4, n_init=1).collect()] == [0.0, 0.0]


def test_similarities_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 7)
    x, df = vectors(spark)
    got = clusters.similarities(df, df.where("k % 20 = 0"), "k", "v").toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 180 and np.allclose(got["similarity"], (u @ u.T)[got["i"], got["j"]])


def test_elbow(spark):
    curve = [100.0, 50.0, 40.0, 35.0, 32.0, 30.0]
    got = clusters.elbow(spark.createDataFrame(list(enumerate(curve, 2)), "k int, inertia double")).orderBy("k").toPandas()
    d = np.diff(curve)
    r = d[1:] / d[:-1]
    assert got.k[got.elbow].tolist() == [range(2, 8)[np.where(r < r.mean())[0][0]]]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_are_exact(spark, by):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 500), "x": rng.integers(0, 50, 500) / 7})
    pdf.loc[pdf.index[::17], "x"] = None
    pdf.loc[pdf["g"] == 3, "x"] = None
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = ordered.quantiles(df, "x", [0, 0.1, 0.5, 0.75, 1], by).toPandas()
    for _, r in got.iterrows():
        x = pdf["x"][pdf["g"] == r["g"]] if by else pdf["x"]
        want = np.quantile(x.dropna(), [0, 0.1, 0.5, 0.75, 1]) if x.notna().any() else [None] * 5
        assert list(r["quantiles"]) == pytest.approx(want) if want[0] is not None else list(r["quantiles"]) == want
    assert len(got) == (4 if by else 1)


def test_even_split_and_symmetry(spark):
    sizes = [r["count"] for r in graph.split_evenly(spark.range(103).withColumnRenamed("id", "k"), "k", 4, 1).groupBy("part").count().orderBy("part").collect()]
    assert sizes == [26, 26, 26, 25]
    m = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0 + 1e-7)], "i string, j string, weight double")
    assert graph.is_symmetric(m).first().ok and not graph.is_symmetric(m.where("i = 'a'")).first().ok


def test_classifiers_on_rows_they_did_not_learn_from(spark):
    rows = [(k, ("good fine day " if k % 2 else "bad sad night ") + f"word{k % 5}", k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, t string, y int")
    learn, rest = df.where("k < 40"), df.where("k >= 40")
    for got in (classify.naive_bayes(learn, rest, "k", "t", "y"), classify.classify(learn, rest, "k", "t", "y", "tree"), classify.classify(learn, rest, "k", "t", "y", "maxent")):
        assert {r.k: r.predicted for r in got.collect()} == {k: y for k, _, y in rows if k >= 40}


def test_systems_of_regressions(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=200), rng.normal(size=200)
    e = rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 200)
    pdf = pd.DataFrame({"a": a, "b": b, "y": 1 + 2 * a + e[:, 0], "z": -1 + 3 * b + e[:, 1]})
    got = regress.sur(spark.createDataFrame(pdf), {"y": ("y", ["a"]), "z": ("z", ["b"])}).set_index(["equation", "term"])["coef"]
    X = [np.column_stack([np.ones(200), pdf[c]]) for c in "ab"]
    first = [np.linalg.lstsq(x, pdf[c], rcond=None)[0] for x, c in zip(X, "yz", strict=True)]
    r = np.column_stack([pdf[c] - x @ f for c, x, f in zip("yz", X, first, strict=True)])
    inv = np.linalg.inv(r.T @ r / 200)
    big = np.block([[X[0], np.zeros((200, 2))], [np.zeros((200, 2)), X[1]]])
    w = np.kron(inv, np.eye(200))
    want = np.linalg.solve(big.T @ w @ big, big.T @ w @ np.concatenate([pdf["y"], pdf["z"]]))
    assert np.allclose(got.to_numpy(), want)


def test_quantile_fit_is_a_vertex_of_least_loss():
    rng = np.random.default_rng(2)
    X = np.column_stack([np.ones(41), rng.normal(size=41)])
    y = X @ [1, 2] + rng.standard_t(2, 41)
    loss = lambda b, q: np.sum((y - X @ b) * (q - (y - X @ b < 0)))
    for q in (0.2, 0.5, 0.77):
        lines = [np.linalg.solve(X[[i, j]], y[[i, j]]) for i in range(41) for j in range(i)]
        assert math.isclose(loss(regress.quantile_fit(X, y, q), q), min(loss(b, q) for b in lines), rel_tol=1e-9)


def test_anderson_darling(spark):
    x = np.sort(np.random.default_rng(4).normal(3, 2, 80))
    got = regress.anderson_darling(spark.createDataFrame([("g", float(v)) for v in x], "g string, v double"), ["g"], "v").first()
    cdf = [0.5 * math.erfc(-(v - x.mean()) / x.std(ddof=1) / math.sqrt(2)) for v in x]
    a2 = -80 - sum((2 * i + 1) * (math.log(cdf[i]) + math.log(1 - cdf[79 - i])) for i in range(80)) / 80
    assert math.isclose(got.a2, a2, rel_tol=1e-9) and got.verdict == "Accept"


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (3.9, 1.0), (4.2, 1.5)], "x double, y double")
    fit = lambda rule: [r.ok for r in points.select(geo.fits(F.col("x"), F.col("y"), F.lit(0.5), geo.ring_of(ring), rule).alias("ok")).collect()]
    assert (fit("center"), fit("within"), fit("intersects")) == ([True, False, True, False], [True, False, False, False], [True, False, True, True])
    d = points.select(geo.to_border(F.col("x"), F.col("y"), geo.ring_of(ring)).alias("d")).toPandas()["d"]
    assert np.allclose(d, [1, 1, 0.1, 0.2])
    grid = geo.circle_grid(spark, ring, 1000.0, 0.5, "within").toPandas()
    assert {(x, y) for x, y in zip(grid.lon, grid.lat, strict=True)} == {(0.5 * i, 0.5 * j) for i in range(1, 8) for j in range(1, 6)}


def test_refinement_goes_on_from_what_is_narrowed(spark):
    items = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("a1", 5), ("a2", 6)], "p string, item int")
    asked = []

    def find(points):
        asked.append(sorted(r.p for r in points.collect()))
        return points.join(items, "p")

    narrow = lambda full: full.select(F.explode(F.array(F.concat("p", F.lit("1")), F.concat("p", F.lit("2")))).alias("p"))
    got = pending.refine(spark.createDataFrame([("a",), ("b",)], "p string"), find, narrow, ["p"], "item", 3, 2)
    assert sorted(r.item for r in got.collect()) == [1, 2, 3, 4, 5, 6] and asked == [["a", "b"], ["a1", "a2"]]


def test_wrapping_and_entities(spark):
    df = spark.createDataFrame([("one two three four",), (None,)], "t string")
    assert [r[0] for r in df.select(python_udfs.wrapped(F.col("t"), 9)).collect()] == ["one two\nthree\nfour", None]
    a = df.select(python_udfs.entities(F.split("t", " "), {"two three": "2_3", "two": "2"}).alias("a")).collect()
    assert a[0].a == ["one", "2_3", "four"] and a[1].a is None


def test_coefficient_tables(spark):
    wide = spark.createDataFrame([("I(x)", "1", "2"), ("z", "3", "4")], "term string, `0.25` string, `0.5` string")
    table = coefficients.classified(coefficients.long(wide, "term", ["0.25", "0.5"]), ["x"], "QuantReg", "y")
    got = [tuple(r) for r in coefficients.sorted_rows(table).collect()]
    assert got == [("QuantReg", "linear", "y", "Exog", "x", 0.25, "1"), ("QuantReg", "linear", "y", "Exog", "x", 0.5, "2"), ("QuantReg", "linear", "y", "Control", "z", 0.25, "3"), ("QuantReg", "linear", "y", "Control", "z", 0.5, "4")]
    assert [r.q50 for r in coefficients.by_quantile(table, [0.25, 0.5]).orderBy("variable").collect()] == ["2", "4"]
    assert {len(r.id) for r in coefficients.identified(table).collect()} == {12}
    shown = coefficients.displayed(table, "variable", {"x": "Income"}, r"^(\w)$")
    assert {r.variable for r in shown.collect()} == {"Income", "z"}


def test_names(spark):
    df = spark.createDataFrame([("brazl",), ("brazilian",), ("uk",), ("qq",), (None,), ("germany",)], "t string")
    got = {r.t: r.country for r in names.countries_in(df, "t", ["brazil", "united kingdom", "germany", "brazzl"], {"brazilian": "brazil"}, 0.8).collect()}
    assert got == {"brazl": "brazzl", "brazilian": "brazil", "uk": "united kingdom", "qq": None, None: None, "germany": "germany"}  # ties go to the later country
    t = spark.createDataFrame([(1.0, 2.0)], "gdp double, gdp_log double")
    assert names.transformed(t, "gdp", "log") == "gdp_log" and names.transformed(t, "gdp") == "gdp"
    with pytest.raises(ArgumentValueError):
        names.transformed(t, "gdp", "square")
    assert names.short_names([{"gdp": ["pop"]}], {"gdp": "g", "gdp_log": "lg", "pop": "p"}, log=True) == [{"lg": ["p"]}]
    assert names.territories(spark).count() == 4


def test_stop_words_are_stored(spark, tmp_path):
    stop = names.StopWords(spark)
    assert "the" in stop.words
    stop.add("foo")
    stop.remove("the")
    stop.save(str(tmp_path / "w"))
    again = names.StopWords.load(spark, str(tmp_path / "w"))
    assert again.words == stop.words
    got = spark.range(1).select(again.without(F.array(F.lit("Foo"), F.lit("the"), F.lit("of"))).alias("a")).first().a
    assert got == ["the"]


def test_bits(spark):
    b = spark.range(1).select(bits.put(bits.put(bits.zeros(12), F.lit(9), F.lit(True)), F.lit(2), F.lit(True)).alias("b"))
    row = b.select(F.hex("b").alias("h"), *(bits.get(F.col("b"), F.lit(k)).alias(f"b{k}") for k in (2, 3, 9, 15, 16)), F.hex(bits.put(F.col("b"), F.lit(99), F.lit(True))).alias("same")).first()
    assert tuple(row) == ("0402", 1, 0, 1, 0, None, "0402")


def test_flows_are_checked(spark):
    good = spark.createDataFrame([("(1990, 1995)", "1_2-Gram", "a b", 3)], "period string, ngram string, gram string, count int")
    assert checks.check_flows(good) is good
    for bad in (good.drop("gram"), good.withColumn("gram", F.lit(1)), good.withColumn("count", F.lit("x")), good.withColumn("period", F.lit("1990")), good.withColumn("ngram", F.lit("3_2-Gram"))):
        with pytest.raises(ArgumentStructureError):
            checks.check_flows(bad)


def test_files(spark, tmp_path):
    files.write_json(spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "j"))
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "j"), "k int, v string").collect()] == [(1, "a")]
    assert json.loads(spark.range(1).select(files.pretty(F.struct(F.lit(1).alias("a"))).alias("p")).first().p) == {"a": 1}
    files.use_database(spark, "some_place", str(tmp_path / "db"))
    assert files.database_folder(spark, "some_place").endswith("db")
    spark.catalog.setCurrentDatabase("default")
    spark.sql("DROP DATABASE some_place")


def test_settings_and_timing(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with context.settings(spark, spark__sql__shuffle__partitions=3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    said, took = [], []
    with context.Timing("x ", took.append, unit="s", say=said.append):
        pass
    assert said[0].startswith("x 0.") and took[0] < 1


def test_scratch_tables_go(spark):
    import os

    with scratch.temporary(spark):
        a = scratch.written(spark.range(3), "gone")
        b = scratch.written(spark.range(4), "kept", keep=True)
        gone, there = (x.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] for x in (a, b))
        assert os.path.isdir(gone)
    assert not os.path.isdir(gone) and os.path.isdir(there) and b.count() == 4


def test_moments_estimator_with_updated_weights(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(400, 2))
    u = rng.normal(size=400)
    x = z @ [1, 0.5] + u
    y = 2 + 3 * x + u * (1 + np.abs(z[:, 0]))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "a": z[:, 0], "b": z[:, 1]}))
    Z, X = np.column_stack([np.ones(400), z]), np.column_stack([np.ones(400), x])

    def cost(beta, at=None):
        e = y - X @ (beta if at is None else at)
        g = Z.T @ (y - X @ beta) / 400
        return g @ np.linalg.inv((Z * e[:, None] ** 2).T @ Z / 400) @ g

    two = series.gmm(df, "y", [], ["x"], ["a", "b"])
    first = np.linalg.solve((X.T @ Z) @ np.linalg.inv(Z.T @ Z) @ (Z.T @ X), (X.T @ Z) @ np.linalg.inv(Z.T @ Z) @ (Z.T @ y))
    best = two["coef"].to_numpy()
    assert all(cost(best, first) <= cost(best + d, first) + 1e-15 for d in rng.normal(scale=1e-3, size=(50, 2))) and math.isclose(two["j"][0], 400 * cost(best, first), rel_tol=1e-6)
    new = series.gmm(df, "y", [], ["x"], ["a", "b"], updating=True)["coef"].to_numpy()
    assert cost(new) < cost(best) and all(cost(new) <= cost(new + d) + 1e-12 for s in (1e-1, 1e-2, 1e-3) for d in rng.normal(scale=s, size=(50, 2)))


def test_switching_autoregression_is_found_again():
    rng = np.random.default_rng(6)
    y, state = [0.0], 0
    for _ in range(1500):
        state = state if rng.random() < 0.95 else 1 - state
        y.append([0.0, 5.0][state] + [0.7, 0.1][state] * y[-1] + rng.normal(scale=[0.5, 1.0][state]))
    y = np.array(y)
    beta, sd, move, _ = series.switching_regression(y[1:], np.column_stack([np.ones(1500), y[:-1]]))
    assert np.allclose(beta, [[0, 0.7], [5, 0.1]], atol=0.25) and np.allclose(sd, [0.5, 1.0], atol=0.15) and np.allclose(np.diag(move), 0.95, atol=0.03)


def test_search_goes_on_after_it_broke_off(spark, tmp_path):
    points, asked = spark.range(10).withColumnRenamed("id", "k"), []

    def find(rows):
        ks = [r.k for r in rows.collect()]
        asked.extend(ks)
        if 5 in ks and asked.count(5) == 1:
            raise RuntimeError("broke off")
        return rows.select((F.col("k") * 10).alias("item"))

    at = str(tmp_path / "s")
    with pytest.raises(RuntimeError):
        pending.search(spark, points, "k", find, at, 100, 3)
    assert pending.any_pending(points, spark.read.parquet(f"{at}/done"), "k")
    found, done = pending.search(spark, points, "k", find, at, 100, 3)
    assert sorted(r.item for r in found.collect()) == list(range(0, 100, 10)) and done.count() == 10 and asked.count(0) == 1
    assert not pending.any_pending(points, done, "k") and pending.any_pending(points, done, "k", recalculate=True)
    assert [pending.save_now(k, 450, k, 10_000) for k in (0, 1, 200, 449)] == [True, False, True, True] and pending.save_now(3, 450, 9, 10)


def test_requests_are_checked():
    for bad in (dict(metres=0), dict(metres=1, language="eng"), dict(metres=1, most=0)):
        with pytest.raises(ArgumentValueError):
            requests.nearby_circle(F.lit(1.0), F.lit(2.0), **bad)
    with pytest.raises(ArgumentValueError):
        requests.nearby(F.lit(1.0), F.lit(2.0), 5, "")


def test_prepared_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "y int, a int, b int, c int")
    assert regress.prepared(df, "y", ["a"], ["c"], {"a": "Income"}).columns == ["y", "Income", "c"]
    with pytest.raises(ArgumentValueError):
        regress.prepared(df, "y", ["q"])
