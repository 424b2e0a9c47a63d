"""Tests and models of series, one series a group: each needs all its rows in order, so a group is one task's work."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .regress import ols as _ols

#: Fixed values of Royston's approximation (1995): weights, and the mean and deviation of the transformed statistic.
SHAPIRO_C1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SHAPIRO_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SHAPIRO_SMALL = ((0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459))
SHAPIRO_LARGE = ((-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302))
#: Fixed values of MacKinnon's response surfaces (2010), one variable with a constant.
ADF_CRITICAL = {1: (-3.43035, -6.5393, -16.786, -79.433), 5: (-2.86154, -2.8903, -4.234, -40.040), 10: (-2.56677, -1.5384, -2.809, 0.0)}


def _poly(c: Sequence[float], x: float) -> float:
    return sum(a * x**i for i, a in enumerate(c))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """W and its p value, for 4 to 5,000 values."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c, u = m / math.sqrt(m @ m), 1 / math.sqrt(n)
    a = np.zeros(n)
    a[-1] = _poly(SHAPIRO_C1, u) + c[-1]
    if n > 5:
        a[-2] = _poly(SHAPIRO_C2, u) + c[-2]
        phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[0], a[1] = -a[-1], -a[-2]
    else:
        phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * a[-1] ** 2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0] = -a[-1]
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    if n <= 11:
        mu, sigma, g = (_poly(p, n) for p in SHAPIRO_SMALL)
        z = (-math.log(g - math.log(1 - w)) - mu) / math.exp(sigma)
    else:
        mu, sigma = (_poly(p, math.log(n)) for p in SHAPIRO_LARGE)
        z = (math.log(1 - w) - mu) / math.exp(sigma)
    return float(w), 1 - NormalDist().cdf(z)


def _fit(y: np.ndarray, X: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    e = y - X @ beta
    return beta, e, float(e @ e)


def dickey_fuller(x: np.ndarray, most: int | None = None) -> tuple[float, int, int]:
    """The augmented statistic with a constant, its lags (least AIC) and rows."""
    x = np.asarray(x, float)
    d = np.diff(x)
    most = min(int(12 * (len(x) / 100) ** 0.25), len(d) // 2 - 2) if most is None else most

    def design(lags: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        y = d[start:]
        return y, np.column_stack([x[start:-1], *(d[start - k : len(d) - k] for k in range(1, lags + 1)), np.ones(len(y))])

    best = None
    for lags in range(max(0, most) + 1):
        y, X = design(lags, max(0, most))
        _, _, rss = _fit(y, X)
        aic = len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * X.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lags)
    y, X = design(best[1], best[1])
    beta, _, rss = _fit(y, X)
    se = math.sqrt(rss / (len(y) - X.shape[1]) * np.linalg.inv(X.T @ X)[0, 0])
    return float(beta[0] / se), best[1], len(y)


def adf_critical(rows: int, percent: int = 5) -> float:
    return _poly(ADF_CRITICAL[percent], 1 / rows)


def _by_group(df: DataFrame, by: Sequence[str], columns: Sequence[str], schema: str, run: Callable[[pd.DataFrame], dict]) -> DataFrame:
    kinds = dict(df.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)
        size = len(next(iter(out.values())))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * size for c in by}, **out})

    head = "".join(f"{c} {kinds[c]}, " for c in by)
    return df.select(*dict.fromkeys([*by, *columns])).groupBy(*by).applyInPandas(one, head + schema)


def shapiro_tests(df: DataFrame, by: Sequence[str], column: str, alpha: float = 0.05) -> DataFrame:
    """W, p and whether normality is accepted, for each group."""

    def run(pdf: pd.DataFrame) -> dict:
        x = pdf[column].dropna().to_numpy(float)
        w, p = shapiro(x) if len(x) > 3 and x.min() < x.max() else (math.nan, math.nan)
        return {"w": [w], "p": [p], "verdict": ["Accept" if p > alpha else "Reject"]}

    return _by_group(df, by, [column], "w double, p double, verdict string", run)


def adf_tests(df: DataFrame, by: Sequence[str], column: str, order: str, percent: int = 5) -> DataFrame:
    """Statistic, critical value, lags and verdict (Accept: no unit root) of each group's series."""

    def run(pdf: pd.DataFrame) -> dict:
        stat, lags, rows = dickey_fuller(pdf.sort_values(order)[column].dropna().to_numpy(float))
        critical = adf_critical(rows, percent)
        return {"statistic": [stat], "critical": [critical], "lags": [lags], "verdict": ["Accept" if stat < critical else "Reject"]}

    return _by_group(df, by, [column, order], "statistic double, critical double, lags int, verdict string", run)


def _loess(y: np.ndarray, span: int) -> np.ndarray:
    """Local linear fits with tricube weights."""
    n = len(y)
    span = min(max(3, span), n)
    t, out = np.arange(n, dtype=float), np.empty(n)
    for i in range(n):
        lo = min(max(0, i - span // 2), n - span)
        s = slice(lo, lo + span)
        far = max(i - lo, lo + span - 1 - i) + 1
        w = (1 - (np.abs(t[s] - i) / far) ** 3) ** 3
        mt, my = np.average(t[s], weights=w), np.average(y[s], weights=w)
        var = np.sum(w * (t[s] - mt) ** 2)
        slope = np.sum(w * (t[s] - mt) * (y[s] - my)) / var if var > 0 else 0.0
        out[i] = my + slope * (i - mt)
    return out


def decompose(y: np.ndarray, periods: Sequence[int], rounds: int = 2, smooth: int = 7) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Trend, one season a period and the rest, by repeated smoothing of each season's cycles."""
    y = np.asarray(y, float)
    seasons = [np.zeros(len(y)) for _ in periods]
    trend = np.zeros(len(y))
    for _ in range(rounds):
        for k, p in enumerate(sorted(periods)):
            free = y - trend - sum((s for j, s in enumerate(seasons) if j != k), np.zeros(len(y)))
            season = np.empty(len(y))
            for phase in range(p):
                season[phase::p] = _loess(free[phase::p], smooth) if len(free[phase::p]) > 2 else free[phase::p].mean()
            level = np.convolve(np.pad(season, (p // 2, p - 1 - p // 2), "edge"), np.ones(p) / p, "valid")
            seasons[k] = season - level
        trend = _loess(y - sum(seasons), 2 * max(periods) + 1)
    return trend, seasons, y - trend - sum(seasons)


def decomposed(df: DataFrame, by: Sequence[str], column: str, order: str, periods: Sequence[int]) -> DataFrame:
    """(by, order, trend, season_<period>..., rest) of each series."""
    kind = dict(df.dtypes)[order]
    names = [f"season_{p}" for p in sorted(periods)]

    def run(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values(order)
        trend, seasons, rest = decompose(pdf[column].to_numpy(float), periods)
        return {order: pdf[order].to_numpy(), "trend": trend, **dict(zip(names, seasons, strict=True)), "rest": rest}

    return _by_group(df, by, [column, order], f"{order} {kind}, trend double, {', '.join(f'{n} double' for n in names)}, rest double", run)


def switching(y: np.ndarray, regimes: int = 2, rounds: int = 200, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, deviations, transitions and log likelihood of a Markov-switching mean, by expectation and maximisation."""
    y = np.asarray(y, float)
    mean = np.quantile(y, (np.arange(regimes) + 0.5) / regimes)
    sd, move = np.full(regimes, y.std() or 1.0), np.full((regimes, regimes), 0.1 / max(1, regimes - 1))
    np.fill_diagonal(move, 0.9)
    start, last = np.full(regimes, 1 / regimes), -math.inf
    for _ in range(rounds):
        dens = np.exp(-0.5 * ((y[:, None] - mean) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)) + 1e-300
        f = np.empty((len(y), regimes))
        scale = np.empty(len(y))
        for t in range(len(y)):
            p = (start if t == 0 else f[t - 1] @ move) * dens[t]
            scale[t] = p.sum()
            f[t] = p / scale[t]
        b = np.ones((len(y), regimes))
        for t in range(len(y) - 2, -1, -1):
            b[t] = move @ (dens[t + 1] * b[t + 1]) / scale[t + 1]
        g = f * b
        g /= g.sum(axis=1, keepdims=True)
        joint = (f[:-1, :, None] * move[None] * (dens[1:] * b[1:] / scale[1:, None])[:, None, :]).sum(axis=0)
        move = joint / joint.sum(axis=1, keepdims=True)
        weight = g.sum(axis=0)
        mean = (g * y[:, None]).sum(axis=0) / weight
        sd = np.sqrt((g * (y[:, None] - mean) ** 2).sum(axis=0) / weight) + 1e-9
        start, like = g[0], float(np.log(scale).sum())
        if abs(like - last) < tol:
            break
        last = like
    order = np.argsort(mean)
    return mean[order], sd[order], move[np.ix_(order, order)], last


def regimes(df: DataFrame, by: Sequence[str], column: str, order: str, k: int = 2) -> DataFrame:
    """(by, regime, mean, sd, stay) of each series."""

    def run(pdf: pd.DataFrame) -> dict:
        mean, sd, move, _ = switching(pdf.sort_values(order)[column].to_numpy(float), k)
        return {"regime": list(range(k)), "mean": mean, "sd": sd, "stay": np.diag(move)}

    return _by_group(df, by, [column, order], "regime int, mean double, sd double, stay double", run)


def factor_premia(df: DataFrame, portfolio: str, ret: str, factors: Sequence[str]) -> tuple[DataFrame, pd.DataFrame]:
    """Two passes: each portfolio's loadings over time, then the premia of the loadings across portfolios."""

    def run(pdf: pd.DataFrame) -> dict:
        rows = pdf.dropna()
        beta, *_ = _fit(rows[ret].to_numpy(float), np.column_stack([np.ones(len(rows)), *(rows[f].to_numpy(float) for f in factors)]))
        return {"mean": [rows[ret].mean()], "alpha": [beta[0]], **{f"beta_{f}": [b] for f, b in zip(factors, beta[1:], strict=True)}}

    cols = ", ".join(f"beta_{f} double" for f in factors)
    loadings = _by_group(df, [portfolio], [ret, *factors], f"mean double, alpha double, {cols}", run)
    return loadings, _ols(loadings, "mean", [f"beta_{f}" for f in factors])


def gmm(df: DataFrame, y: str, exogenous: Sequence[str], endogenous: Sequence[str], instruments: Sequence[str], updating: bool = False) -> pd.DataFrame:
    """Efficient moments estimator: two steps, or the weights updated with the coefficients until both rest.

    One distributed pass adds up products of up to four columns; everything else is as small as the
    model and done on the driver, since the moments' covariance at any coefficients is a sum of these.
    """
    from itertools import combinations_with_replacement

    from pyspark.sql import functions as F

    from .regress import two_stage

    X, Z = ["const", *exogenous, *endogenous], ["const", *exogenous, *instruments]
    names = list(dict.fromkeys(["const", *exogenous, *endogenous, *instruments, y]))
    full = df.dropna(subset=names[1:])
    col = lambda c: F.lit(1.0) if c == "const" else F.col(c).cast("double")
    W = [y, *X]
    zz, ww = list(combinations_with_replacement(range(len(Z)), 2)), list(combinations_with_replacement(range(len(W)), 2))
    row = full.agg(F.count("*").alias("n"), *(F.sum(col(Z[a]) * col(Z[b]) * col(W[c]) * col(W[d])).alias(f"s{a}_{b}_{c}_{d}") for a, b in zz for c, d in ww)).first()
    n, s4 = row["n"], np.zeros((len(Z), len(Z), len(W), len(W)))
    for a, b in zz:
        for c, d in ww:
            s4[a, b, c, d] = s4[b, a, c, d] = s4[a, b, d, c] = s4[b, a, d, c] = row[f"s{a}_{b}_{c}_{d}"] / n
    zw = s4[:, 0, :, 1]  # Z[0] and W[1] are the constant
    zy, zx = zw[:, 0], zw[:, 1:]

    def weights(beta: np.ndarray) -> np.ndarray:
        e = np.concatenate(([1.0], -beta))
        return np.linalg.inv(np.einsum("abcd,c,d->ab", s4, e, e))

    def solved(w: np.ndarray) -> np.ndarray:
        return np.linalg.solve(zx.T @ w @ zx, zx.T @ w @ zy)

    def cost(beta: np.ndarray) -> float:
        g = zy - zx @ beta
        return float(g @ weights(beta) @ g)

    beta = solved(weights(two_stage(df, y, exogenous, endogenous, instruments)["coef"].to_numpy()))
    if updating:
        beta = _least(cost, beta)
    w = weights(beta) if updating else weights(two_stage(df, y, exogenous, endogenous, instruments)["coef"].to_numpy())
    g = zy - zx @ beta
    se = np.sqrt(np.diag(np.linalg.inv(zx.T @ w @ zx)) / n)
    return pd.DataFrame({"term": X, "coef": beta, "se": se, "z": beta / se, "j": n * g @ w @ g, "n": n})


def _least(cost: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """A minimum near start by Newton steps on numeric derivatives, halved while they do not help."""
    x, now = start.astype(float), cost(start)
    for _ in range(rounds):
        h = 1e-4 * np.maximum(np.abs(x), 1e-3)
        step = np.diag(h)
        grad = np.array([(cost(x + d) - cost(x - d)) / (2 * k) for d, k in zip(step, h, strict=True)])
        hess = np.array([[(cost(x + a + b) - cost(x + a - b) - cost(x - a + b) + cost(x - a - b)) / (4 * p * q) for b, q in zip(step, h, strict=True)] for a, p in zip(step, h, strict=True)])
        scale = np.sqrt(np.abs(np.diag(hess))) + 1e-300
        lam, v = np.linalg.eigh(hess / np.outer(scale, scale))
        move = -(v @ ((v.T @ (grad / scale)) / np.maximum(np.abs(lam), 1e-9))) / scale
        while cost(x + move) > now and np.abs(move / h).max() > 1e-6:
            move /= 2
        if cost(x + move) >= now:
            break
        x, now = x + move, cost(x + move)
    return x


def switching_regression(y: np.ndarray, X: np.ndarray, regimes: int = 2, rounds: int = 300, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(coefficients by regime, deviations, moves, log likelihood) of a regression whose coefficients switch with a hidden chain, by EM."""
    n, k = len(y), regimes
    cut = np.array_split(np.argsort(y - X @ np.linalg.lstsq(X, y, rcond=None)[0], kind="stable"), k)
    p = np.full((n, k), 0.1 / max(1, k - 1))
    for j, at in enumerate(cut):
        p[at, j] = 0.9
    move, start, last = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)), np.full(k, 1 / k), -np.inf
    for _ in range(rounds):
        beta = np.array([np.linalg.lstsq(X * np.sqrt(p[:, [j]]), y * np.sqrt(p[:, j]), rcond=None)[0] for j in range(k)])
        e2 = (y[:, None] - X @ beta.T) ** 2
        sd = np.sqrt(np.maximum((p * e2).sum(0) / p.sum(0), 1e-12 * max(y.var(), 1e-12)))
        dens = np.exp(-0.5 * e2 / sd**2) / (sd * np.sqrt(2 * np.pi)) + 1e-300
        f, c = np.empty((n, k)), np.empty(n)
        for t in range(n):
            f[t] = (start if t == 0 else f[t - 1] @ move) * dens[t]
            c[t] = f[t].sum()
            f[t] /= c[t]
        b, pair = np.ones((n, k)), np.zeros((k, k))
        for t in range(n - 2, -1, -1):
            ahead = dens[t + 1] * b[t + 1] / c[t + 1]
            pair += f[t][:, None] * move * ahead[None, :]
            b[t] = move @ ahead
        p = f * b
        p /= p.sum(1, keepdims=True)
        move, start, now = pair / np.maximum(pair.sum(1, keepdims=True), 1e-300), p[0], float(np.log(c).sum())
        if abs(now - last) < tol * abs(now):
            break
        last = now
    order = np.argsort(beta[:, 0])
    return beta[order], sd[order], move[np.ix_(order, order)], now


def autoregressive_regimes(df: DataFrame, by: Sequence[str], column: str, order: str, lags: int = 1, k: int = 2) -> DataFrame:
    """(by, regime, const, lag_1 .., sd, stay) of each series whose autoregression switches."""

    def run(pdf: pd.DataFrame) -> dict:
        x = pdf.sort_values(order)[column].to_numpy(float)
        X = np.column_stack([np.ones(len(x) - lags), *(x[lags - j : len(x) - j] for j in range(1, lags + 1))])
        beta, sd, move, _ = switching_regression(x[lags:], X, k)
        return {"regime": list(range(k)), "const": beta[:, 0], **{f"lag_{j}": beta[:, j] for j in range(1, lags + 1)}, "sd": sd, "stay": np.diag(move)}

    cols = ", ".join(f"lag_{j} double" for j in range(1, lags + 1))
    return _by_group(df, by, [column, order], f"regime int, const double, {cols}, sd double, stay double", run)
