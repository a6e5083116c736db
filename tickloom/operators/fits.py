"""Maximum-likelihood fits of variance models, one series at a time on many executors, and what follows from them."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from ..functions.distributions import cdf, log_pdf, ppf
from .affine import affine_scan, compose
from .series import ordered

#: Parameters of each model besides omega, with where they are looked for. omega is a factor of what gives the sample variance.
SPACE = {
    "garch": {"alpha": (0.0, 0.6), "beta": (0.0, 0.995)},
    "igarch": {"alpha": (0.001, 0.8)},
    "tarch": {"alpha": (0.0, 0.5), "gamma": (0.0, 0.6), "beta": (0.0, 0.995)},
    "aparch": {"alpha": (0.0, 0.5), "gamma": (-0.9, 0.9), "beta": (0.0, 0.995), "delta": (0.8, 3.0)},
    "egarch": {"alpha": (-0.2, 0.8), "gamma": (-0.5, 0.5), "beta": (-0.5, 0.995)},
    "agarch": {"alpha": (0.0, 0.6), "gamma": (-0.5, 0.5), "beta": (0.0, 0.995)},
}
NORMAL_ABS = math.sqrt(2 / math.pi)


def persistence(model: str, p: dict) -> np.ndarray:
    """How much of a variance (of its logarithm for egarch, its power for aparch) is carried on, under normal innovations."""
    if model == "igarch":
        return np.ones_like(p["alpha"])
    if model == "egarch":
        return p["beta"]
    if model == "tarch":
        return p["alpha"] + p["gamma"] / 2 + p["beta"]
    if model == "aparch":
        d = p["delta"]
        moment = 2 ** ((d - 2) / 2) * np.vectorize(math.gamma)((d + 1) / 2) / math.sqrt(math.pi)  # E of z^d over z > 0
        return p["alpha"] * moment * ((1 - p["gamma"]) ** d + (1 + p["gamma"]) ** d) + p["beta"]
    return p["alpha"] + p["beta"]


def paths(model: str, r: np.ndarray, p: dict) -> np.ndarray:
    """Variances (rows, candidates) of returns under arrays of parameters; the first row has the sample variance."""
    level = float(np.mean(r * r))
    d = p.get("delta", np.full_like(p["omega"], 2.0))
    s = {"egarch": np.full_like(p["omega"], math.log(level)), "aparch": np.mean(np.abs(r)[:, None] ** d, 0)}.get(model, np.full_like(p["omega"], level))
    out = np.empty((len(r), len(s)))
    alpha, gamma = p["alpha"], p.get("gamma", np.zeros_like(p["omega"]))
    beta = 1 - alpha if model == "igarch" else p["beta"]
    for t, x in enumerate(r):
        out[t] = s
        if model == "egarch":
            z = x * np.exp(-s / 2)
            s = np.clip(p["omega"] + alpha * (np.abs(z) - NORMAL_ABS) + gamma * z + beta * s, -60, 60)
        elif model == "aparch":
            s = p["omega"] + alpha * (abs(x) - gamma * x) ** d + beta * s
        elif model == "tarch":
            s = p["omega"] + (alpha + (gamma if x < 0 else 0)) * (x * x) + beta * s
        elif model == "agarch":
            s = np.maximum(p["omega"] + alpha * (x * x) + gamma * x * np.sqrt(s) + beta * s, 1e-12 * level)
        else:
            s = p["omega"] + alpha * (x * x) + beta * s
    return np.exp(out) if model == "egarch" else out ** (2 / d) if model == "aparch" else out


def _omega(model: str, p: dict, factor: np.ndarray, r: np.ndarray) -> np.ndarray:
    """omega that makes the model's own level ``factor`` times the sample's."""
    level = float(np.mean(r * r))
    if model == "egarch":
        return (math.log(level) + np.log(factor)) * (1 - p["beta"])
    if model == "igarch":
        return level * factor * 0.02
    base = np.mean(np.abs(r)[:, None] ** p["delta"], 0) if model == "aparch" else level
    return base * factor * np.maximum(1 - persistence(model, p), 1e-3)


def simplex(f, start: np.ndarray, step: np.ndarray, most: int = 2000, near: float = 1e-9) -> tuple[np.ndarray, float]:
    """(x, f(x)) at a minimum of ``f``, by reflecting, stretching and shrinking a simplex; restarted once from where it settles."""
    best, value = np.array(start, float), math.inf
    for scale in (1.0, 0.1):
        points = [best, *(best + scale * step[k] * np.eye(len(best))[k] for k in range(len(best)))]
        x = np.array(points)
        y = np.array([f(p) for p in x])
        for _ in range(most):
            order = np.argsort(y, kind="stable")
            x, y = x[order], y[order]
            if y[-1] - y[0] < near and np.abs(x - x[0]).max() < 1e-7:
                break
            centre = x[:-1].mean(0)
            r = centre + (centre - x[-1])
            v = f(r)
            if v < y[0]:
                e = centre + 2 * (centre - x[-1])
                u = f(e)
                x[-1], y[-1] = (e, u) if u < v else (r, v)
            elif v < y[-2]:
                x[-1], y[-1] = r, v
            else:
                c = centre + 0.5 * ((r if v < y[-1] else x[-1]) - centre)
                u = f(c)
                if u < min(v, y[-1]):
                    x[-1], y[-1] = c, u
                else:
                    x[1:] = x[0] + 0.5 * (x[1:] - x[0])
                    y[1:] = [f(p) for p in x[1:]]
        k = int(np.argmin(y))
        best, value = x[k], float(y[k])
    return best, value


def one_path(model: str, r: np.ndarray, p: dict, max_lag: int = 100) -> np.ndarray:
    """The variances of one series under one set of parameters; models that are affine in their state are composed in vectors."""
    n, level = len(r), float(np.mean(r * r))
    if model == "figarch":
        weights = np.array(figarch_weights(p["d"], p["phi"], p["beta"], max_lag))
        sums = np.convolve(r * r, np.r_[0.0, weights])[:n]
        return np.where(np.arange(n) < max_lag, level, p["omega"] / (1 - p["beta"]) + sums)
    if model in ("egarch", "agarch"):
        w, a, g, b = (p[k] for k in ("omega", "alpha", "gamma", "beta"))
        out, s = [], math.log(level) if model == "egarch" else level
        for x in r.tolist():
            out.append(s)
            if model == "egarch":
                z = x * math.exp(-s / 2)
                s = min(max(w + a * (abs(z) - NORMAL_ABS) + g * z + b * s, -60.0), 60.0)
            else:
                s = max(w + a * (x * x) + g * x * math.sqrt(s) + b * s, 1e-12 * level)
        return np.exp(out) if model == "egarch" else np.array(out)
    beta = 1 - p["alpha"] if model == "igarch" else p["beta"]
    start, power = level, 2.0
    if model == "aparch":
        power = p["delta"]
        start, push = float(np.mean(np.abs(r) ** power)), p["alpha"] * (np.abs(r) - p["gamma"] * r) ** power
    elif model == "tarch":
        push = (p["alpha"] + p["gamma"] * (r < 0)) * r * r
    else:
        push = p["alpha"] * r * r
    c = np.r_[start, p["omega"] + push[:-1]][None, :]
    b = np.full((1, n), beta)
    b[0, 0] = 0.0
    v = compose(b, c)[0]
    return v if power == 2.0 else np.maximum(v, 1e-300) ** (2 / power)


#: FIGARCH's parameters and where they are looked for; all weights must be positive, which is checked.
SPACE_FIGARCH = {"d": (0.01, 0.99), "phi": (0.0, 0.8), "beta": (0.0, 0.95)}


def fit_series(r: np.ndarray, model: str = "garch", family: str = "normal", nu: float = 8.0, max_lag: int = 100) -> dict:
    """The likeliest parameters of one series: a coarse grid, then a simplex search from its best points; the same on every machine.

    omega is searched as a factor of what gives the sample's own variance.
    FIGARCH is scored after its first ``max_lag`` rows, which have no path.
    """
    space = SPACE_FIGARCH if model == "figarch" else SPACE[model]
    names = [*space, "factor"]
    low = np.array([*(a for a, _ in space.values()), math.log(0.05)])
    high = np.array([*(b for _, b in space.values()), math.log(20)])
    skip = max_lag if model == "figarch" else 0
    level = float(np.mean(r * r))

    def at(x: np.ndarray) -> dict | None:
        if (x < low).any() or (x > high).any():
            return None
        p = dict(zip(names, (float(v) for v in x), strict=True))
        factor = math.exp(p.pop("factor"))
        if model == "figarch":
            w = figarch_weights(p["d"], p["phi"], p["beta"], max_lag)
            if min(w) < 0:
                return None
            return {"omega": level * factor * max(1 - sum(w), 1e-3) * (1 - p["beta"]), **p}
        one = {k: np.array([v]) for k, v in p.items()}
        if model != "igarch" and float(persistence(model, one)[0]) >= 1:
            return None
        return {"omega": float(np.ravel(_omega(model, one, np.array([factor]), r))[0]), **p}

    def loss(x: np.ndarray) -> float:
        p = at(x)
        if p is None:
            return math.inf
        with np.errstate(all="ignore"):
            v = one_path(model, r, p, max_lag)[skip:]
            ll = float((log_pdf(r[skip:] / np.sqrt(v), family, nu) - 0.5 * np.log(v)).sum())
        return -ll if math.isfinite(ll) else math.inf

    points = {2: 9, 3: 6, 4: 4}.get(len(names), 3)
    inner = [np.linspace(a + (b - a) * 0.08, b - (b - a) * 0.03, points) for a, b in space.values()]
    grid = [np.array([*x, 0.0]) for x in product(*inner)]
    scored = sorted((loss(x), tuple(x)) for x in grid)[:2]
    step = (high - low) * 0.1
    best = min((simplex(loss, np.array(x), step) for v, x in scored if math.isfinite(v)), key=lambda f: f[1], default=None)
    if best is None:
        return {**dict.fromkeys(("omega", *space), math.nan), "loglik": -math.inf}
    return {**at(best[0]), "loglik": -best[1]}


PARAMS = ("omega", "alpha", "gamma", "beta", "delta")
FIT = "model string, omega double, alpha double, gamma double, beta double, delta double, persistence double, loglik double, n long, aic double, bic double"


def fit_panel(df: DataFrame, keys: list[str], order: list[str], model: str = "garch", ret: str = "ret", family: str = "normal", nu: float = 8.0, least: int = 20, max_lag: int = 100) -> DataFrame:
    """(keys, FIT): maximum-likelihood parameters of every series under innovations of a family.

    A series is fitted in one task (bound its length); the panel is what
    scales. Series of fewer than ``least`` returns (three times ``max_lag`` for
    figarch), or without spread, are left out. figarch gives ``d`` in delta and ``phi`` in alpha.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    names = [*keys, *(c.split()[0] for c in FIT.split(", "))]

    def one(key, pdf):
        r = pdf.sort_values(order)[ret].to_numpy(float)
        if len(r) < least or not np.any(r != 0):
            return pd.DataFrame(columns=names)
        if model == "figarch" and len(r) < 3 * max_lag:
            return pd.DataFrame(columns=names)
        f = fit_series(r, model, family, nu, max_lag)
        k = len(SPACE_FIGARCH if model == "figarch" else SPACE[model]) + 1
        carried = sum(figarch_weights(f["d"], f["phi"], f["beta"], max_lag)) if model == "figarch" else float(persistence(model, {n: np.array([v]) for n, v in f.items()})[0])
        if model == "igarch":
            f["beta"] = 1 - f["alpha"]
        if model == "figarch":
            f["delta"], f["alpha"] = f["d"], f["phi"]
        row = [*key, model, *(f.get(n) for n in PARAMS), carried, f["loglik"], len(r), 2 * k - 2 * f["loglik"], k * math.log(len(r)) - 2 * f["loglik"]]
        return pd.DataFrame([row], columns=names)

    rows = df.where(F.col(ret).isNotNull()).select(*dict.fromkeys([*keys, *order, ret]))
    return rows.groupBy(*keys).applyInPandas(one, f"{kinds}, {FIT}")


def score_candidates(df: DataFrame, keys: list[str], order: list[str], candidates: list[tuple[float, float, float]], ret: str = "ret", chunk: Column | None = None) -> DataFrame:
    """(keys, candidate, loglik): GARCH(1,1) likelihoods of every series under every (omega, alpha, beta).

    All candidates are paths of one affine scan, and their terms one sum each;
    ``chunk`` (see ``affine``) cuts few long series.
    """
    r2 = F.col(ret) * F.col(ret)
    paths = {f"_v{k}": (b, w + a * r2, F.col("_level")) for k, (w, a, b) in enumerate(candidates)}
    done = affine_scan(df.select(*keys, *order, ret), keys, order, paths, {"_level": F.avg(r2)}, chunk, before=True)
    terms = [F.sum(-0.5 * (math.log(2 * math.pi) + F.log(f"_v{k}") + r2 / F.col(f"_v{k}"))) for k in range(len(candidates))]
    wide = done.groupBy(*keys).agg(F.array(*terms).alias("_l"))
    return wide.select(*keys, F.posexplode("_l").alias("candidate", "loglik"))


def _backwards(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])


def forecast_orders(path: DataFrame, params: DataFrame, keys: list[str], order: list[str], horizon: int, ret: str = "ret") -> DataFrame:
    """(keys, h, var): GARCH forecasts of any orders from a path with ``var`` and a table (keys, omega, alpha array, beta array).

    The state of a series is its last variances and squared returns, as many as
    its weights; a step multiplies it by the companion matrix of the weights, in
    which a square still to come is its variance. Series that lack rows for
    their weights get no forecast; a null return or variance ends the state.
    """
    sizes = params.agg(F.max(F.array_size("alpha")), F.max(F.array_size("beta"))).first()
    p, q = (max(x or 0, 1) for x in sizes)
    keep = max(p, q)
    last = path.withColumn("_i", F.row_number().over(_backwards(keys, order))).where(F.col("_i") <= keep)  # kept before the shuffle, too
    last = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", F.col(ret).cast("double").alias("r"), F.col("var").cast("double").alias("v")))).alias("_last"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in params.select(*keys).schema)

    def run(frames):
        for pdf in frames:
            rows = [(i, len(a), len(b)) for i, (a, b) in enumerate(zip(pdf["alpha"], pdf["beta"], strict=True))]
            known = np.full((len(rows), 2, keep), np.nan)
            weights, omega = np.zeros((len(rows), p + q)), pdf["omega"].to_numpy(float)
            for i, n_a, n_b in rows:
                weights[i, :n_a], weights[i, p : p + n_b] = pdf["alpha"].iloc[i], pdf["beta"].iloc[i]
                for k, x in enumerate(pdf["last"].iloc[i]):
                    known[i, 0, k], known[i, 1, k] = (math.nan if x["r"] is None else x["r"] ** 2), (math.nan if x["v"] is None else x["v"])
            state = np.concatenate([known[:, 0, :p], known[:, 1, :q]], axis=1)
            state[weights == 0] = 0.0
            first, out = weights, []  # the first step still has the last return's own square
            shift = np.zeros((p + q, p + q))
            shift[range(1, p), range(p - 1)] = 1
            shift[range(p + 1, p + q), range(p, p + q - 1)] = 1
            for h in range(1, horizon + 1):
                v = omega + (first * np.where(first == 0, 0.0, state)).sum(1)
                state = state @ shift.T
                state[:, 0] = state[:, p] = v
                out.append(v)
            var = np.stack(out, 1)
            good = np.isfinite(var).all(1)
            yield pd.DataFrame({c: np.repeat(pdf[c].to_numpy()[good], horizon) for c in keys} | {"h": np.tile(np.arange(1, horizon + 1), int(good.sum())), "var": var[good].ravel()})

    joined = params.join(last, keys).select(*keys, "omega", "alpha", "beta", F.col("_last").alias("last"))
    return joined.mapInPandas(run, f"{kinds}, h int, var double")


def best_candidate(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, candidate, loglik) of the likeliest, the first among equals."""
    return scores.groupBy(*keys).agg(F.max(F.struct("loglik", (-F.col("candidate")).alias("c"))).alias("b")).select(*keys, (-F.col("b.c")).alias("candidate"), "b.loglik")


def compare_models(fits: list[DataFrame], keys: list[str]) -> DataFrame:
    """All fits of every series with ``aic_rank``, ``bic_rank`` and, from the least AIC, ``best``."""
    both = reduce(DataFrame.unionByName, fits)
    w = Window.partitionBy(*keys)
    both = both.withColumns({f"{c}_rank": F.row_number().over(w.orderBy(c, "model")) for c in ("aic", "bic")})
    return both.withColumn("best", F.col("aic_rank") == 1)


def levels(params: DataFrame) -> DataFrame:
    """Fitted parameters with the unconditional variance and the half-life of a shock; null where a variance has no level."""
    p, m = F.col("persistence"), F.col("model")
    power = F.col("omega") / F.nullif(1 - p, F.lit(0.0))
    level = F.when(m == "egarch", F.exp(power)).when(m == "aparch", F.pow(power, 2 / F.col("delta"))).otherwise(power)
    fine = (p < 1) & (p > -1)
    return params.withColumns({"unconditional": F.when(fine & (m != "igarch"), level), "half_life": F.when((p < 1) & (p > 0), F.log(F.lit(0.5)) / F.log(p))})


def forecast(last: DataFrame, params: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """(keys, model, h, var) from each series' last return ``r`` and variance ``v`` and its fitted parameters.

    The first step uses the return; later ones the expected recursion: towards
    the level by the persistence, straight up for igarch, in logarithms for
    egarch and in powers for aparch.
    """
    j = last.join(params, keys)
    r, v = F.col("r"), F.col("v")
    w, a, g, b, d, m = (F.col(c) for c in ("omega", "alpha", "gamma", "beta", "delta", "model"))
    z = r / F.sqrt(v)
    one = (
        F.when(m == "egarch", w + a * (F.abs(z) - NORMAL_ABS) + g * z + b * F.log(v))
        .when(m == "aparch", w + a * F.pow(F.abs(r) - g * r, d) + b * F.pow(v, d / 2))
        .when(m == "tarch", w + (a + F.when(r < 0, g).otherwise(0.0)) * r * r + b * v)
        .when(m == "agarch", w + a * r * r + g * r * F.sqrt(v) + b * v)
        .otherwise(w + a * r * r + b * v)
    )
    steps = j.withColumns({"_one": one, "h": F.explode(F.sequence(F.lit(1), F.lit(horizon)))})
    p, k = F.col("persistence"), F.col("h") - 1
    level = w / F.nullif(1 - p, F.lit(0.0))
    state = F.when(p == 1, F.col("_one") + w * k).otherwise(level + (F.col("_one") - level) * F.pow(p, k))
    out = F.when(m == "egarch", F.exp(state)).when(m == "aparch", F.pow(state, 2 / d)).otherwise(state)
    return steps.select(*keys, "model", "h", out.alias("var"))


def forecast_quantiles(forecasts: DataFrame, probabilities: list[float], family: str = "normal", nu: float = 8.0, lam: float = 0.0, mean: float = 0.0) -> DataFrame:
    """``forecasts`` with a row and a ``quantile`` of the return for each probability; quantiles of the family are literals of the plan."""
    z = [float(x) for x in ppf(probabilities, family, nu, lam)]
    points = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(x).alias("z")) for p, x in zip(probabilities, z, strict=True)]))
    return forecasts.withColumn("_q", points).withColumns({"p": F.col("_q.p"), "quantile": mean + F.sqrt("var") * F.col("_q.z")}).drop("_q")


def news_impact(params: DataFrame, shocks: list[float]) -> DataFrame:
    """Fitted parameters (one level each, see ``levels``) against shocks: the next variance from the level."""
    e, v = F.col("shock"), F.col("unconditional")
    w, a, g, b, d, m = (F.col(c) for c in ("omega", "alpha", "gamma", "beta", "delta", "model"))
    out = (
        F.when(m == "egarch", F.exp(w + a * (F.abs(e) / F.sqrt(v) - NORMAL_ABS) + g * e / F.sqrt(v) + b * F.log(v)))
        .when(m == "aparch", F.pow(w + a * F.pow(F.abs(e) - g * e, d) + b * F.pow(v, d / 2), 2 / d))
        .when(m == "tarch", w + (a + F.when(e < 0, g).otherwise(0.0)) * e * e + b * v)
        .when(m == "agarch", w + a * e * e + g * e * F.sqrt(v) + b * v)
        .otherwise(w + a * e * e + b * v)
    )
    return params.withColumn("shock", F.explode(F.array(*map(F.lit, shocks)))).withColumn("var", out)


def figarch_weights(d: float, phi: float, beta: float, lags: int) -> list[float]:
    """Weights of past squares of a fractionally integrated model with one lag of each kind."""
    delta, out = d, [phi - beta + d]
    for k in range(2, lags + 1):
        later = (k - 1 - d) / k * delta
        out.append(beta * out[-1] + later - phi * delta)
        delta = later
    return out


def figarch(df: DataFrame, keys: list[str], order: list[str], omega: float, d: float, phi: float, beta: float, max_lag: int, ret: str = "ret") -> DataFrame:
    """``var``: omega / (1 - beta) and weighted past squares; the first ``max_lag`` rows have the sample variance, so keep it below a series' length.

    A sum of lags in one window: no state is carried, and Spark reads each series in order once.
    """
    w = ordered(keys, order)
    weights = figarch_weights(d, phi, beta, max_lag)
    past = F.collect_list(F.col(ret) * F.col(ret)).over(w.rowsBetween(-max_lag, -1))
    total = F.aggregate(F.zip_with(past, F.lit([float(x) for x in reversed(weights)]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    level = F.avg(F.col(ret) * F.col(ret)).over(Window.partitionBy(*keys))
    return df.withColumns({"_pos": F.row_number().over(w), "_level": level, "_sum": total}).withColumn("var", F.when(F.col("_pos") <= max_lag, F.col("_level")).otherwise(F.lit(omega / (1 - beta)) + F.col("_sum"))).drop("_pos", "_level", "_sum")


def figarch_forecast(df: DataFrame, keys: list[str], order: list[str], omega: float, d: float, phi: float, beta: float, max_lag: int, horizon: int, ret: str = "ret") -> DataFrame:
    """(keys, h, var) from the last ``max_lag`` squares of each series; forecasts stand in for squares that are still to come."""
    weights = figarch_weights(d, phi, beta, max_lag)
    last = df.withColumn("_i", F.row_number().over(_backwards(keys, order))).where(F.col("_i") <= max_lag)
    last = last.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", (F.col(ret) * F.col(ret)).alias("s")))), lambda x: x["s"]).alias("sq"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                past = list(r.sq)
                for h in range(1, horizon + 1):
                    v = omega / (1 - beta) + sum(w * x for w, x in zip(weights, past))
                    past.insert(0, v)
                    out.append((*[getattr(r, c) for c in keys], h, v))
            yield pd.DataFrame(out, columns=[*keys, "h", "var"])

    return last.mapInPandas(run, f"{kinds}, h int, var double")


def value_at_risk(forecasts: DataFrame, share: float = 0.05, family: str = "normal", nu: float = 8.0) -> Column:
    """The loss that a forecast's return exceeds with probability ``share``."""
    return -F.sqrt(forecasts["var"]) * float(ppf([share], family, nu)[0])


def pit(path: DataFrame, ret: str = "ret", family: str = "normal", nu: float = 8.0) -> DataFrame:
    """``path`` with ``pit``, the probability of each return under its variance."""

    def run(frames):
        for pdf in frames:
            yield pdf.assign(pit=cdf(pdf[ret].to_numpy(float) / np.sqrt(pdf["var"].to_numpy(float)), family, nu))

    return path.mapInPandas(run, T.StructType([*path.schema.fields, T.StructField("pit", T.DoubleType())]))
