"""Linear models: one distributed pass adds up moments, the driver solves systems as small as the regressors.

Robust, quantile and grouped models run inside groups with numpy; the simple ones are SQL aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentValueError


def moments(df: DataFrame, columns: Sequence[str], intercept: bool = True) -> tuple[int, np.ndarray, list[str]]:
    """(rows, matrix of summed products, names) of complete rows, from one aggregate."""
    names = (["const"] if intercept else []) + list(columns)
    full = df.dropna(subset=list(columns))
    col = lambda c: F.lit(1.0) if c == "const" else F.col(c).cast("double")
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    row = full.agg(F.count("*").alias("n"), *(F.sum(col(names[i]) * col(names[j])).alias(f"m{k}") for k, (i, j) in enumerate(pairs))).first()
    m = np.zeros((len(names), len(names)))
    for k, (i, j) in enumerate(pairs):
        m[i, j] = m[j, i] = row[f"m{k}"] or 0.0
    return row["n"], m, names


def centred_moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, matrix of summed products about the means) of complete rows, from one aggregate that centres as it adds."""
    full = df.dropna(subset=list(columns)).select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    row = full.agg(F.count("*").alias("n"), *(F.avg(f"c{i}").alias(f"a{i}") for i in range(len(columns))), *(F.covar_pop(f"c{i}", f"c{j}").alias(f"m{k}") for k, (i, j) in enumerate(pairs))).first()
    s = np.zeros((len(columns), len(columns)))
    for k, (i, j) in enumerate(pairs):
        s[i, j] = s[j, i] = (row[f"m{k}"] or 0.0) * row["n"]
    return row["n"], np.array([row[f"a{i}"] or 0.0 for i in range(len(columns))]), s


def ols(df: DataFrame, y: str, xs: Sequence[str], intercept: bool = True) -> pd.DataFrame:
    """One row a regressor: coefficient, standard error, t, and the model's R2 and rows."""
    if intercept:
        n, mean, s = centred_moments(df, [*sorted(xs), y])
        names, part = ["const", *sorted(xs), y], np.linalg.inv(s[:-1, :-1])
        slope, tss = part @ s[:-1, -1], s[-1, -1]
        beta, rss = np.concatenate(([mean[-1] - slope @ mean[:-1]], slope)), tss - slope @ s[:-1, -1]
        side = -part @ mean[:-1]
        inv = np.block([[np.array([[1 / n + mean[:-1] @ part @ mean[:-1]]]), side[None, :]], [side[:, None], part]])
    else:
        n, m, names = moments(df, [*sorted(xs), y], False)
        inv, tss = np.linalg.inv(m[:-1, :-1]), m[-1, -1]
        beta = inv @ m[:-1, -1]
        rss = tss - beta @ m[:-1, -1]
    se = np.sqrt(np.maximum(rss, 0) / (n - len(beta)) * np.diag(inv))
    return pd.DataFrame({"term": names[:-1], "coef": beta, "se": se, "t": beta / se, "r2": 1 - rss / tss, "n": n})


def simple(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and R2 of y on x, for each group."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def _centred(df: DataFrame, columns: Sequence[str], by: Sequence[str], theta=1.0) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumns({c: F.col(c) - theta * F.avg(c).over(w) for c in columns})


def within(df: DataFrame, y: str, x: str, entity: str) -> DataFrame:
    """The slope with entity fixed effects."""
    c = _centred(df, [y, x], [entity])
    return c.agg(F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("slope"), F.count("*").alias("n"))


def between(df: DataFrame, y: str, x: str, entity: str) -> DataFrame:
    """OLS on entity means."""
    return simple(df.groupBy(entity).agg(F.avg(y).alias(y), F.avg(x).alias(x)), y, x)


def first_difference(df: DataFrame, y: str, x: str, entity: str, time: str) -> DataFrame:
    """OLS without a constant on differences."""
    w = Window.partitionBy(entity).orderBy(time)
    d = df.select((F.col(y) - F.lag(y).over(w)).alias("dy"), (F.col(x) - F.lag(x).over(w)).alias("dx")).dropna()
    return d.agg(F.try_divide(F.sum(F.col("dx") * F.col("dy")), F.sum(F.col("dx") * F.col("dx"))).alias("slope"), F.count("*").alias("n"))


def random_effects(df: DataFrame, y: str, x: str, entity: str) -> pd.DataFrame:
    """GLS with theta from the within and between variances (balanced or mean panel length)."""
    n_i = df.groupBy(entity).agg(F.count("*").alias("t"), F.avg(y).alias("my"), F.avg(x).alias("mx"))
    s = n_i.agg(F.count("*").alias("k"), F.avg("t").alias("t"), (F.count("*") / F.sum(1 / F.col("t"))).alias("th")).first()
    w = ols(_centred(df, [y, x], [entity]), y, [x], intercept=False)
    c = _centred(df, [y, x], [entity])
    slope = float(w["coef"].iloc[0])
    e2 = c.agg(F.sum(F.pow(F.col(y) - slope * F.col(x), F.lit(2)))).first()[0]
    total = df.count()
    sigma_e = e2 / (total - s["k"] - 1)
    b = ols(n_i.select(F.col("my").alias(y), F.col("mx").alias(x)), y, [x])
    fit = dict(zip(b["term"], b["coef"], strict=True))
    u2 = n_i.agg(F.sum(F.pow(F.col("my") - fit["const"] - fit[x] * F.col("mx"), F.lit(2)))).first()[0]
    sigma_u = max(0.0, u2 / (s["k"] - 2) - sigma_e / s["th"])
    theta = 1 - math.sqrt(sigma_e / (sigma_e + s["t"] * sigma_u))
    q = _centred(df.withColumn("_one", F.lit(1.0)), [y, x, "_one"], [entity], theta)
    out = ols(q, y, [x, "_one"], intercept=False)
    return out.assign(theta=theta, term=out["term"].replace("_one", "const"))


def iv_simple(df: DataFrame, y: str, x: str, z: str) -> DataFrame:
    """One endogenous regressor and one instrument."""
    return df.agg(F.try_divide(F.covar_samp(z, y), F.covar_samp(z, x)).alias("slope"))


def two_stage(df: DataFrame, y: str, exogenous: Sequence[str], endogenous: Sequence[str], instruments: Sequence[str], k: float = 1.0) -> pd.DataFrame:
    """k-class estimator from moments: 1 is two-stage least squares; liml() finds its own k."""
    n, m, names = moments(df, [*exogenous, *endogenous, *instruments, y])
    at = {c: i for i, c in enumerate(names)}
    X, Z, Y = (["const", *exogenous, *endogenous], ["const", *exogenous, *instruments], [y])
    pick = lambda a, b: m[np.ix_([at[c] for c in a], [at[c] for c in b])]
    proj = lambda a, b: pick(a, Z) @ np.linalg.solve(pick(Z, Z), pick(Z, b))
    left = (1 - k) * pick(X, X) + k * proj(X, X)
    beta = np.linalg.solve(left, (1 - k) * pick(X, Y) + k * proj(X, Y))[:, 0]
    rss = pick(Y, Y)[0, 0] - 2 * beta @ pick(X, Y)[:, 0] + beta @ pick(X, X) @ beta
    se = np.sqrt(rss / (n - len(beta)) * np.diag(np.linalg.inv(left)))
    return pd.DataFrame({"term": X, "coef": beta, "se": se, "t": beta / se, "n": n})


def liml(df: DataFrame, y: str, exogenous: Sequence[str], endogenous: Sequence[str], instruments: Sequence[str]) -> pd.DataFrame:
    """Limited-information maximum likelihood: k is the least root of the variance ratio."""
    n, m, names = moments(df, [*exogenous, *endogenous, *instruments, y])
    at = {c: i for i, c in enumerate(names)}
    W, Z1, Z = [y, *endogenous], ["const", *exogenous], ["const", *exogenous, *instruments]
    pick = lambda a, b: m[np.ix_([at[c] for c in a], [at[c] for c in b])]
    left_over = lambda zs: pick(W, W) - pick(W, zs) @ np.linalg.solve(pick(zs, zs), pick(zs, W))
    k = float(np.min(np.linalg.eigvals(np.linalg.solve(left_over(Z), left_over(Z1))).real))
    return two_stage(df, y, exogenous, endogenous, instruments, k)


def residuals(df: DataFrame, y: str, x: str, name: str = "e") -> DataFrame:
    """Rows with the residual of y on x; the line is one row joined back."""
    line = F.broadcast(df.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a")))
    return df.crossJoin(line).withColumn(name, F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")


def durbin_watson(df: DataFrame, y: str, x: str, by: str, order: Sequence[str]) -> DataFrame:
    """Within each series of the model's residuals: sum of squared steps over the sum of squares."""
    w = Window.partitionBy(by).orderBy(*order)
    e = residuals(df, y, x).withColumn("d", F.col("e") - F.lag("e").over(w))
    return e.groupBy(by).agg(F.try_divide(F.sum(F.col("d") * F.col("d")), F.sum(F.col("e") * F.col("e"))).alias("dw"))


def breusch_pagan(df: DataFrame, y: str, x: str) -> DataFrame:
    """LM = n R2 of squared residuals on x."""
    e = residuals(df, y, x).withColumn("e2", F.col("e") * F.col("e"))
    return e.agg((F.regr_count("e2", x) * F.regr_r2("e2", x)).alias("lm"))


def white(df: DataFrame, y: str, x: str) -> pd.DataFrame:
    """LM = n R2 of squared residuals on x and x squared, and its chi-square tail."""
    e = residuals(df, y, x).select((F.col("e") * F.col("e")).alias("e2"), F.col(x), (F.col(x) * F.col(x)).alias("x2"))
    fit = ols(e, "e2", [x, "x2"])
    lm = float(fit["n"].iloc[0] * fit["r2"].iloc[0])
    return pd.DataFrame({"lm": [lm], "p": [chi2_tail(lm, 2)]})


def vif(df: DataFrame, xs: Sequence[str], threshold: float = 5.0) -> pd.DataFrame:
    """Diagonal of the inverse correlation matrix."""
    _, _, s = centred_moments(df, sorted(xs))
    sd = np.sqrt(np.diag(s))
    v = np.diag(np.linalg.inv(s / np.outer(sd, sd)))
    return pd.DataFrame({"term": sorted(xs), "vif": v, "verdict": np.where(v <= threshold, "Accept", "Reject")})


def rolling(df: DataFrame, y: str, x: str, by: Sequence[str], order: Sequence[str], window: int = 30, least: int | None = None) -> DataFrame:
    """Slope and intercept over the last rows of each series; the windowed aggregates centre what they add up."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(window - 1), 0)
    ok = F.count(x).over(w) >= (window if least is None else least)
    return df.withColumn("slope", F.when(ok, F.regr_slope(y, x).over(w))).withColumn("intercept", F.when(ok, F.regr_intercept(y, x).over(w)))


def chi2_tail(x: float, k: int) -> float:
    """P(chi-square with k degrees > x) by the incomplete gamma function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 1.0
    if z < a + 1:
        term = total = 1 / a
        for i in range(1, 1000):
            term *= z / (a + i)
            total += term
            if term < total * 1e-15:
                break
        return 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a))
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


def quantile_fit(X: np.ndarray, y: np.ndarray, q: float, iterations: int = 200) -> np.ndarray:
    """Quantile regression by iteratively reweighted least squares."""
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    for _ in range(iterations):
        e = y - X @ beta
        w = np.where(e >= 0, q, 1 - q) / np.maximum(np.abs(e), 1e-6)
        new = np.linalg.solve(X.T @ (X * w[:, None]), X.T @ (w * y))
        if np.abs(new - beta).max() < 1e-8:
            break
        beta = new
    return _vertex(X, y, q, beta)


def _vertex(X: np.ndarray, y: np.ndarray, q: float, beta: np.ndarray) -> np.ndarray:
    """The best fit through as many points as there are terms, of the points nearest to beta's: an optimum is one of these.

    Of fits with one loss the one with the least last coefficient is taken.
    """
    loss = lambda b: float(np.sum((y - X @ b) * (q - (y - X @ b < 0))))
    near = np.argsort(np.abs(y - X @ beta), kind="stable")[: X.shape[1] + 14]
    best, low = beta, np.inf
    for at in combinations(near.tolist(), X.shape[1]):
        part = X[list(at)]
        if abs(np.linalg.det(part)) > 1e-12 * np.prod(np.linalg.norm(part, axis=1)):
            b = np.linalg.solve(part, y[list(at)])
            now = loss(b)
            if now < low * (1 - 1e-9) or (now <= low * (1 + 1e-9) and tuple(b[::-1]) < tuple(best[::-1])):
                best, low = b, now
    return best if low <= loss(beta) * (1 + 1e-9) else beta


def huber_fit(X: np.ndarray, y: np.ndarray, t: float = 1.345, iterations: int = 100) -> np.ndarray:
    """Huber's M-estimator, the scale by the median absolute deviation."""
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    for _ in range(iterations):
        e = y - X @ beta
        s = np.median(np.abs(e - np.median(e))) / 0.6744897501960817 or 1e-12
        w = 1 / np.maximum(1.0, np.abs(e / s) / t)
        new = np.linalg.solve(X.T @ (X * w[:, None]), X.T @ (w * y))
        if np.abs(new - beta).max() < 1e-10:
            break
        beta = new
    return beta


def grouped(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], fit: Callable[[np.ndarray, np.ndarray], np.ndarray], extra: str = "") -> DataFrame:
    """(by, term, coef) of a fit inside each group; a group is one task's work, as the method needs all its rows."""
    kinds = dict(df.dtypes)
    terms = ["const", *sorted(xs)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.dropna(subset=[y, *xs])
        X = np.column_stack([np.ones(len(rows)), *(rows[c].to_numpy(float) for c in sorted(xs))])
        beta = fit(X, rows[y].to_numpy(float)) if len(rows) > len(terms) else np.full(len(terms), np.nan)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(terms) for c in by}, "term": terms, "coef": beta})

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", term string, coef double"
    return df.select(*dict.fromkeys([*by, y, *xs])).groupBy(*by).applyInPandas(run, schema)


def anderson_darling(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """A2 against the normal with estimated mean and deviation, corrected for size, and the 1 % verdict."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[column].dropna().to_numpy(float))
        n = len(x)
        z = (x - x.mean()) / x.std(ddof=1)
        cdf = np.clip(np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z]), 1e-300, 1 - 1e-16)
        i = np.arange(1, n + 1)
        a2 = -n - np.mean((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1])))
        critical = round(1.035 / (1 + 0.75 / n + 2.25 / n**2), 3) if n else float("nan")
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "a2": [a2], "critical": [critical], "verdict": ["Accept" if a2 < critical else "Reject"]})

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", a2 double, critical double, verdict string"
    return df.select(*by, column).groupBy(*by).applyInPandas(run, schema)


def sur(df: DataFrame, equations: dict[str, tuple[str, Sequence[str]]]) -> pd.DataFrame:
    """Seemingly unrelated regressions by feasible GLS, from moments of all columns."""
    columns = sorted({c for y, xs in equations.values() for c in (y, *xs)})
    n, m, names = moments(df, columns)
    at = {c: i for i, c in enumerate(names)}
    pick = lambda a, b: m[np.ix_([at[c] for c in a], [at[c] for c in b])]
    X = {e: ["const", *xs] for e, (_, xs) in equations.items()}
    beta = {e: np.linalg.solve(pick(X[e], X[e]), pick(X[e], [equations[e][0]]))[:, 0] for e in X}
    full = {e: np.concatenate(([1.0], -beta[e])) for e in X}
    sigma = np.array([[full[a] @ pick([equations[a][0], *X[a]], [equations[b][0], *X[b]]) @ full[b] / n for b in X] for a in X])
    inv = np.linalg.inv(sigma)
    es = list(X)
    A = np.block([[inv[i, j] * pick(X[a], X[b]) for j, b in enumerate(es)] for i, a in enumerate(es)])
    b = np.concatenate([sum(inv[i, j] * pick(X[a], [equations[c][0]])[:, 0] for j, c in enumerate(es)) for i, a in enumerate(es)])
    out = np.linalg.solve(A, b)
    rows = [(e, t) for e in es for t in X[e]]
    return pd.DataFrame({"equation": [r[0] for r in rows], "term": [r[1] for r in rows], "coef": out})


def predictions(ranges: DataFrame, coefficients: dict[str, float], x: str, points: int = 100) -> DataFrame:
    """intercept + b1 x + b2 x^2 on an even grid from the least to the largest x."""
    ends = ranges.agg(F.min(x).alias("a"), F.max(x).alias("b"))
    at = ends.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), (F.col("a") + F.col("k") * (F.col("b") - F.col("a")) / (points - 1)).alias("x"))
    b = lambda name: F.lit(float(coefficients.get(name, 0.0)))
    return at.withColumn("y", b("intercept") + b("x") * F.col("x") + b("x2") * F.col("x") * F.col("x"))


def prepared(df: DataFrame, y: str, xs: Sequence[str], controls: Sequence[str] = (), names: dict[str, str] | None = None) -> DataFrame:
    """The dependent, independent and control columns, under mapped names where there are some."""
    missing = [c for c in (y, *xs, *controls) if c not in df.columns]
    if missing:
        raise ArgumentValueError(f"no such columns: {missing}")
    return df.select(*dict.fromkeys([y, *xs, *controls])).withColumnsRenamed(names or {})


def require_columns(df: DataFrame, y: str | None, xs: Sequence[str] | None, formula: str | None = None) -> tuple[str, list[str]]:
    """A formula 'y ~ a + b' or a dependent and independent columns, never both."""
    if (formula is None) == (y is None):
        raise ArgumentValueError("give a formula or columns, one of the two")
    if formula:
        left, right = formula.split("~")
        y, xs = left.strip(), [t.strip() for t in right.split("+")]
    missing = [c for c in (y, *xs) if c not in df.columns]
    if missing:
        raise ArgumentValueError(f"no such columns: {missing}")
    return y, sorted(xs)
