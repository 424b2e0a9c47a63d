"""Operators against values worked out by hand or by pandas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainmill.errors import ArgumentTypeError, ArgumentValueError
from grainmill.functions import geo, python_udfs, scalars
from grainmill.operators import clusters, complexity, distributions, graph, ordered, prep, regress, reshape, select, text
from grainmill.sources import records, tables
from grainmill.streaming import pending


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_selection(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    assert rows(select.rows_by_label(df, "k", [1, 3]), "k") == [(1, "a"), (3, None)]
    with pytest.raises(ArgumentValueError):
        select.rows_by_label(df, "k", [9], must_exist=True)
    with pytest.raises(ArgumentTypeError):
        select.checked(df, 5)
    with pytest.raises(ArgumentValueError):
        select.renamed(df, {"k": "v"})
    assert rows(select.full_text(df, ["k", "v"]).select("full_text"), "full_text") == [("1 a",), ("2 b",), ("3 nan",)]
    assert select.renamed(df, {"new": "k"}, inverse=True).columns == ["new", "v"]


def test_preparation(spark):
    df = spark.createDataFrame([("1.9",), ("-1.9",), ("x",), (None,), ("nan",)], "v string")
    assert sorted(r[0] for r in prep.to_int(df, ["v"], -1).collect()) == [-1, -1, -1, -1, 1]
    n = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    z = [r[0] for r in prep.standardized(n, ["x"]).collect()]
    assert np.allclose(sorted(z), (np.arange(1, 5) - 2.5) / np.std([1, 2, 3, 4], ddof=1))
    assert rows(prep.min_max(spark.createDataFrame([(5.0,), (5.0,)], "x double"), ["x"])) == [(0.0,), (0.0,)]


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 5.0, 9.0, 10.0], [3.0, 3.0, 3.5], list(np.random.default_rng(1).normal(size=42))])
def test_bins_as_pandas(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    got = [r[0] for r in prep.equal_width_bins(df, "x", 4).orderBy("i").select("bin").collect()]
    assert got == (pd.cut(pd.Series(values), 4, labels=False) + 1).tolist()
    got = [r[0] for r in prep.quantile_bins(df, "x", 3).orderBy("i").select("quantile").collect()]
    want = pd.qcut(pd.Series(values), 3, labels=False, duplicates="drop") + 1
    if want.nunique() == 3:
        assert got == want.tolist()


@pytest.mark.parametrize("method", ["average", "min", "max", "dense", "first"])
@pytest.mark.parametrize("ascending", [True, False])
def test_ranks_as_pandas(spark, method, ascending):
    values = [3.0, 1.0, 2.0, 2.0, None, 3.0, 3.0, 0.5]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = [r.rank for r in ordered.ranked(df, "x", method, ascending, tie="i").orderBy("i").collect()]
    want = pd.Series(values, dtype=float).rank(method=method, ascending=ascending).tolist()
    assert [None if w != w else w for w in want] == [None if g is None else float(g) for g in got]


def test_lags_and_growth(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0)], "t int, x double")
    assert [r[-1] for r in rows(prep.growth(df, ["x"], 1, ["t"], percent=True), "t")] == [None, 50.0, 50.0]
    assert [r[-1] for r in rows(prep.shifted(df, ["x"], -1, ["t"]), "t")] == [2.0, 4.0, None]
    assert [r[-1] for r in rows(prep.arithmetic(df.withColumn("z", F.lit(0.0)), ["x"], "z", "/"), "t")] == [None] * 3


def test_reshapes(spark):
    df = spark.createDataFrame([(1, "a", "u", 1.0), (1, "a", "v", 2.0), (2, "b", "u", 3.0)], "t int, g string, s string, x double")
    assert rows(reshape.group_panel(df, "g", "a", "s", ["u", "v"], "x", "t"), "t") == [(1, 1.0, 2.0), (2, None, None)]
    assert rows(reshape.dense_grid(df, "g", "s", "x"), "g", "s") == [("a", "u", 1.0), ("a", "v", 2.0), ("b", "u", 3.0), ("b", "v", 0.0)]
    with pytest.raises(ArgumentValueError):
        reshape.aggregate("first", "x")


def test_complexity(spark):
    m = np.array([[10.0, 0, 5], [2, 8, 1], [0, 3, 9]])
    df = spark.createDataFrame([(f"o{i}", f"p{j}", float(m[i, j])) for i in range(3) for j in range(3)], "origin string, product string, value double")
    want = m * m.sum() / np.outer(m.sum(1), m.sum(0))
    got = {(r.origin, r["product"]): r.rca for r in complexity.advantage(df).collect()}
    assert all(math.isclose(got[f"o{i}", f"p{j}"], want[i, j], abs_tol=1e-12) for i in range(3) for j in range(3))
    has = want >= 1
    near = {(r.i, r.j): r.weight for r in complexity.proximity(complexity.advantage(df).where("rca >= 1")).collect()}
    both, k = has.T.astype(int) @ has, has.sum(0)
    for i in range(3):
        for j in range(3):
            if i != j and both[i, j]:
                assert math.isclose(near[f"p{i}", f"p{j}"], both[i, j] / max(k[i], k[j]))


def test_complexity_index_as_eig(spark):
    rng = np.random.default_rng(5)
    m = (rng.random((8, 6)) < 0.5).astype(float)
    m[0], m[:, 0] = 1, 1
    df = spark.createDataFrame([(i, j) for i in range(8) for j in range(6) if m[i, j]], "origin int, product int")
    eci, pci = complexity.complexity(df)
    d, u = m.sum(1), m.sum(0)
    w, v = np.linalg.eig(np.diag(1 / u) @ m.T @ np.diag(1 / d) @ m)
    want = v[:, np.argsort(w.real)[-2]].real
    got = [r.pci for r in pci.orderBy("product").collect()]
    assert abs(np.corrcoef(got, want)[0, 1]) > 0.999999
    assert abs(np.mean([r.eci for r in eci.collect()])) < 1e-9


def test_spanning_tree_against_kruskal(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(round(w, 2))) for a, b, w in zip(rng.integers(0, 25, 120), rng.integers(0, 25, 120), rng.random(120), strict=True) if a != b]
    best: dict = {}
    for a, b, w in edges:
        best[min(a, b), max(a, b)] = max(w, best.get((min(a, b), max(a, b)), -1))
    up = list(range(25))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    total = 0.0
    for (a, b), w in sorted(best.items(), key=lambda e: -e[1]):
        if find(a) != find(b):
            up[find(a)] = find(b)
            total += w
    got = graph.spanning_tree(spark.createDataFrame(edges, "i int, j int, weight double")).collect()
    assert math.isclose(sum(r.weight for r in got), total, abs_tol=1e-9)


def test_text(spark):
    df = spark.createDataFrame([(1, "The cat sat. The cat!"), (2, None), (3, "a cat2 dog")], "d int, t string")
    got = {(r.d, r.term): r.n for r in text.term_counts(df, ["d"], "t", (1, 2), stop_words=["the"]).collect()}
    assert got == {(1, "cat"): 2, (1, "sat"): 1, (1, "cat sat"): 1, (1, "sat cat"): 1, (3, "cat2"): 1, (3, "dog"): 1, (3, "cat2 dog"): 1}
    w = text.tfidf(text.term_counts(df, ["d"], "t"), "d").groupBy("d").agg(F.sum(F.col("tfidf") ** 2).alias("s")).collect()
    assert all(math.isclose(r.s, 1.0) for r in w)


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("adjustable", "adjust"), ("happy", "happi"), ("controlling", "control"), ("sky", "sky")])
def test_stems(word, want):
    assert python_udfs.stem(word) == want


def test_lcs_and_ratio():
    assert python_udfs.lcs_ratio("", "a") == 0 and python_udfs.lcs_ratio("ab", "xabx") == 0.5
    assert math.isclose(python_udfs.lcs_ratio("abcde", "axcye"), 3 / 5)
    assert python_udfs.partial_ratio("abc", "xxabcxx") == 100


def test_scalars(spark):
    df = spark.createDataFrame([("a1 -2.5 . x3",)], "s string")
    assert df.select(scalars.numbers_in(F.col("s"))).first()[0] == [1.0, 2.5, 0.0, 3.0]
    assert df.select(scalars.metres_to_degrees(F.lit(-1.0), F.lit(0.0))).first()[0] is None
    assert df.select(scalars.stars(F.lit(0.005)), scalars.tag(F.lit("q"), {"a": "b"}, {"b": "c"})).first()[:] == ("**", "X")
    assert df.select(scalars.decoded(F.lit(b"\xe9t\xe9 \x80").cast("binary"))).first()[0] == "été €"


def test_clusters(spark):
    x = np.array([[0.0, 0], [0, 1], [5, 5], [5, 6], [9, 0]])
    c = [0, 0, 1, 1, 1]
    df = spark.createDataFrame([(i, c[i], x[i].tolist()) for i in range(5)], "k int, c int, v array<double>")
    s = {r.k: r.silhouette for r in clusters.silhouette(df, "k", "c", "v").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    a, b = d[0, 1], d[0, 2:].mean()
    assert math.isclose(s[0], (b - a) / max(a, b))
    got = {r.k: r.cluster for r in clusters.agglomerate(df.withColumn("g", F.lit(1)), ["g"], "k", "v", 3, "average").collect()}
    assert got[0] == got[1] and got[2] == got[3] and len({got[0], got[2], got[4]}) == 3


def test_regressions(spark):
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=200), rng.normal(size=200)
    y = 1 + 2 * x - 3 * z + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c), int(i % 5)) for i, (a, b, c) in enumerate(zip(y, x, z, strict=True))], "y double, x double, z double, g int")
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x, z]), y, rcond=None)[0]
    assert np.allclose(regress.ols(df, "y", ["x", "z"])["coef"], want)
    assert np.allclose(regress.two_stage(df, "y", ["z"], ["x"], ["x"])["coef"].sort_values(), np.sort(want))
    assert np.allclose(sorted(regress.sur(df, {"a": ("y", ["x", "z"])})["coef"]), sorted(want))
    assert np.allclose(regress.huber_fit(np.column_stack([np.ones(200), x, z]), y), want, atol=0.05)
    assert np.allclose(regress.quantile_fit(np.column_stack([np.ones(200), x, z]), y, 0.5), want, atol=0.05)
    assert math.isclose(regress.chi2_tail(5.991464547, 2), 0.05, rel_tol=1e-6)
    assert regress.require_columns(df, None, None, "y ~ z + x") == ("y", ["x", "z"])
    with pytest.raises(ArgumentValueError):
        regress.require_columns(df, "y", ["x"], "y ~ x")


def test_distributions(spark):
    v = [1.0, 2, 2, 3, 9, 30]
    df = spark.createDataFrame([(1, float(a)) for a in v], "k int, x double")
    counts = {r.bin: r.n for r in distributions.histogram(df, "x", 5).collect()}
    want = np.histogram(v, 5)[0]
    assert [counts.get(i, 0) for i in range(5)] == want.tolist()
    d = distributions.describe(df, "x").first()
    assert math.isclose(d["skewness"], pd.Series(v).skew()) and math.isclose(d["kurtosis"], pd.Series(v).kurt())


def test_records(spark):
    ics = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:1\nSUMMARY:long\n  er\nDTSTART:20240102T030405Z\nATTENDEE;CN=a:mailto:a@x\nATTENDEE:mailto:b@x\nEND:VEVENT\nEND:VCALENDAR"
    got = records.parsed(spark.createDataFrame([(ics,), (None,)], "t string"), "calendar_events", "t", []).collect()
    assert [(r.uid, r.summary, r.attendees) for r in got] == [("1", "long er", ["a@x", "b@x"])]
    log = ". regress y x\n  y | Coef.\n  x~1 | 1.5 .5 3.0 0.001 .5 2.5\n. xtreg z w, fe\n  w | -2 1 -2.0 0.05 -4 0\n"
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in records.log_coefficients(log)] == [(0, "regress", "y", "x~1", 1.5), (1, "xtreg", "z", "w", -2.0)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, x int")
    path = str(tmp_path / "seq")
    tables.store_sequence(df, "s", path)
    assert tables.is_sequence(spark, "s", path, ["a", "b"]) and not tables.is_sequence(spark, "s", path, ["a"])
    assert [r.x for r in tables.load_sequence(spark, "s", path, ["b"]).collect()] == [2]
    with pytest.raises(ArgumentValueError):
        tables.load_sequence(spark, "s", path, ["z"])
    with pytest.raises(ArgumentTypeError):
        tables.read_table(spark, "t", 3)


def test_stream(spark, tmp_path):
    df = spark.range(10).withColumn("ts", F.timestamp_seconds(F.col("id") * 1000))
    for k in range(2):
        df.where(F.col("id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = pending.stream(spark, df.schema, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda x: x.where("id < 8"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    assert pending.resume(df, df.where("id < 4"), "id", "id", 3).count() == 3


def test_geo(spark):
    square, at = geo.ring_of([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]), F.lit
    row = spark.range(1).select(geo.inside(at(0.5), at(0.5), square).alias("a"), geo.inside(at(1.5), at(0.5), square).alias("b"), geo.to_border(at(0.5), at(0.2), square).alias("d")).first()
    assert row.a and not row.b and math.isclose(row.d, 0.2)


def test_series():
    from grainmill.operators import series

    w, p = series.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert math.isclose(w, 0.79, abs_tol=0.005) and math.isclose(p, 0.007, abs_tol=0.002)  # the example of the paper
    rng = np.random.default_rng(0)
    steps = rng.normal(size=400)
    assert series.dickey_fuller(steps)[0] < series.adf_critical(399) < series.dickey_fuller(np.cumsum(steps))[0]
    t = np.arange(140)
    trend, (season,), rest = series.decompose(0.1 * t + np.tile([0, 1, 2, 3, 2, 1, -9.0], 20), [7])
    assert np.abs(rest[14:-14]).max() < 0.3 and np.allclose(trend + season + rest, 0.1 * t + np.tile([0, 1, 2, 3, 2, 1, -9.0], 20))
    y = np.concatenate([rng.normal(0, 1, 200), rng.normal(8, 1, 200)])
    mean, _, move, _ = series.switching(y)
    assert np.allclose(mean, [0, 8], atol=0.3) and move[0, 0] > 0.95


def test_gmm_and_premia(spark):
    from grainmill.operators import series

    rng = np.random.default_rng(1)
    z, v = rng.normal(size=(2, 800))
    x = z + v
    y = 1 + 2 * x + v + rng.normal(size=800)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(c**2)) for a, b, c in zip(y, x, z, strict=True)], "y double, x double, z double, z2 double")
    assert np.allclose(series.gmm(df, "y", [], ["x"], ["z", "z2"])["coef"], [1, 2], atol=0.15)
    f = rng.normal(size=60)
    rows = [(k, float(b * (0.5 + f[t]))) for k, b in enumerate((0.5, 1.0, 1.5, 2.0)) for t in range(60)]
    rows = [(k, r, float(f[i % 60])) for i, (k, r) in enumerate(rows)]
    loadings, premia = series.factor_premia(spark.createDataFrame(rows, "p int, r double, f double"), "p", "r", ["f"])
    assert np.allclose(sorted(r.beta_f for r in loadings.collect()), [0.5, 1, 1.5, 2])
    assert math.isclose(premia.set_index("term")["coef"]["beta_f"], 0.5 + f.mean(), rel_tol=1e-6)
