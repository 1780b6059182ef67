"""Random-effects meta-analysis of strata: REML between-study variance, Hartung-Knapp, prediction intervals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, inf, lgamma, log, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.shared import written

#: Most steps of the grid's logarithm, also far below all variances; how far it goes beyond scales, most steps by which a peak is narrowed.
STEP, COARSE, REACH, NARROWINGS = 0.05, 0.5, 1e12, 120
#: Numbers held at once by a profile and by slopes (what a core's cache holds), studies of a block of strata and of a bucket (as a mean).
CELLS, SLICE, BLOCK, BUCKET = 1 << 20, 1 << 15, 2000, 20_000
#: Rounds and points by which a peak of a large stratum is narrowed, to some 1e-12 of it.
ROUNDS, POINTS = 10, 33


@lru_cache(10_000)
def t_quantile(p: float, df: int) -> float:
    """Student's t quantile for p above one half, by bisection of its distribution's incomplete beta function."""

    def upper(t: float) -> float:
        return 0.5 * _incomplete_beta(df / (df + t * t), df / 2, 0.5)

    low, high = 0.0, 1.0
    while upper(high) > 1 - p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if upper(middle) > 1 - p else (low, middle)
    return (low + high) / 2


def _incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def _profiles(tau2: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The REML profile log-likelihood of strata of one size (rows of ``y`` and ``v``) at each of their ``tau2``."""
    out = np.empty(tau2.shape)
    step = max(1, CELLS // y.size)
    for at in range(0, tau2.shape[1], step):
        w = 1 / (v[:, None, :] + tau2[:, at : at + step, None])
        whole = w.sum(axis=2)
        mean = (w * y[:, None, :]).sum(axis=2) / whole
        out[:, at : at + step] = -0.5 * (-np.log(w).sum(axis=2) + np.log(whole) + (w * (y[:, None, :] - mean[:, :, None]) ** 2).sum(axis=2))
    return out


def _profile(tau2: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The profile of one stratum."""
    return _profiles(tau2[None, :], y[None, :], v[None, :])[0]


def _grid(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """0, and points STEP apart at most in the logarithm, REACH below ``low`` to REACH above ``high`` of each stratum."""
    low, high = np.log(np.maximum(low / REACH, 1e-300)), np.log(np.minimum(np.maximum(high, low) * REACH, 1e300))
    n = int(np.ceil((high - low).max() / STEP)) + 1
    points = np.exp(low[:, None] + (high - low)[:, None] * np.linspace(0, 1, n))
    return np.concatenate([np.zeros((len(points), 1)), points], axis=1)


def _peaks(value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of ``value`` that no neighbour is above, and that may narrow to the highest of their row.

    Between points STEP apart a profile of ``k`` studies rises by less than 1e-4 * k; what is level with the first column,
    as it is below all scales, is no peak.
    """
    edge = np.full((len(value), 1), -inf)
    high = (value >= np.hstack([edge, value[:, :-1]])) & (value >= np.hstack([value[:, 1:], edge]))
    level = np.abs(value - value[:, :1]) <= 1e-11 * np.maximum(1, np.abs(value[:, :1]))
    return np.nonzero(high & ~level & (value >= value.max(axis=1, keepdims=True) - 1e-3 - 1e-4 * k))


def _points(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """0 and points from REACH below ``low`` to ``high`` of each stratum: STEP apart at most in the logarithm, COARSE from
    where all variances are 20 times as large, as weights hardly change there."""
    low, knee, high = np.log(np.maximum(low / REACH, 1e-300)), np.log(np.maximum(low / 20, 1e-300)), np.log(high)
    parts = [np.zeros((len(low), 1))]
    for a, b, step, last in ((low, knee, COARSE, False), (knee, high, STEP, True)):
        parts.append(np.exp(a[:, None] + (b - a)[:, None] * np.linspace(0, 1, int(np.ceil((b - a).max() / step)) + 1, endpoint=last)))
    return np.concatenate(parts, axis=1)


def _slopes(tau2: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Twice the slope of the profile in tau2, at each of their ``tau2``, as :func:`_profiles` takes them."""
    out = np.empty(tau2.shape)
    step = max(1, SLICE // y.size)
    for at in range(0, tau2.shape[1], step):
        w = 1 / (v[:, None, :] + tau2[:, at : at + step, None])
        whole = w.sum(axis=2)
        off = y[:, None, :] - (np.einsum("ijk,ik->ij", w, y) / whole)[:, :, None]
        off *= w
        out[:, at : at + step] = np.einsum("ijk,ijk->ij", off, off) - (whole - np.einsum("ijk,ijk->ij", w, w) / whole)
    return out


def _roots(a: np.ndarray, b: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Where the slope of each row turns from rising at ``a`` to not rising at ``b``: Newton's steps, halves where they leave."""
    a, b = a.copy(), b.copy()
    t = (a + b) / 2
    for turn in range(NARROWINGS):
        w = 1 / (v + t[:, None])
        whole, squares = w.sum(axis=1), (w * w).sum(axis=1)
        off = y - ((w * y).sum(axis=1) / whole)[:, None]
        cubes = w * w * w
        slope = (w * w * off * off).sum(axis=1) - (whole - squares / whole)
        bend = 2 * (w * w * off).sum(axis=1) ** 2 / whole - 2 * (cubes * off * off).sum(axis=1) + squares - 2 * cubes.sum(axis=1) / whole + (squares / whole) ** 2
        a, b = np.where(slope > 0, t, a), np.where(slope > 0, b, t)
        with np.errstate(divide="ignore", invalid="ignore"):
            to = t - slope / bend
        to = np.where((to > a) & (to < b) & (turn < 20), to, (a + b) / 2)
        moved, t = np.abs(to - t), to
        if (moved <= 1e-14 * t).all():
            break
    return t


def reml_tau2s(y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The maximum over tau2 >= 0 of the profile of each of some strata of one size.

    In the logarithm of tau2 each weight is a logistic step about its variance, one unit wide, so points STEP apart see
    every rise and fall of their sum. Each turn from rising to falling is narrowed, and the highest counts. All of them
    lie below the largest variance and the squared range R^2 of y: of a tau2 above both, weights differ by a factor of
    2 at most, so with W their sum no share of it exceeds 2 / (k + 1), and twice the slope, which is
    sum(w^2 (y - mean)^2) - (W - sum(w^2) / W), is at most W R^2 / (4 tau2) - W / 3, which is below 0.
    """
    grid = _points(v.min(axis=1), np.maximum(v.max(axis=1), np.ptp(y, axis=1) ** 2))
    rising = _slopes(grid, y, v) > 0
    row, at = np.nonzero(rising[:, :-1] & ~rising[:, 1:])
    best, top = np.zeros(len(y)), _profiles(np.zeros((len(y), 1)), y, v)[:, 0]
    for part in filter(len, np.array_split(np.arange(len(row)), 1 + len(row) * y.shape[1] // SLICE)):
        r = row[part]
        found = _roots(grid[r, at[part]], grid[r, at[part] + 1], y[r], v[r])
        for i, t, f in zip(r.tolist(), found.tolist(), _profiles(found[:, None], y[r], v[r])[:, 0].tolist(), strict=True):
            if f > top[i]:
                best[i], top[i] = t, f
    return best


def reml_tau2(y: np.ndarray, v: np.ndarray) -> float:
    """:func:`reml_tau2s` of one stratum."""
    return float(reml_tau2s(y[None, :], v[None, :])[0])


def analysed(k: int, tau2: float, weight: float, effect: float, spread: float, level: float = 0.95, hartung_knapp: bool = True) -> tuple[float, ...]:
    """tau2, effect, se, ci_low, ci_high, pi_low, pi_high from the sum of weights, their mean and their weighted squares.

    Of two studies or more; Hartung-Knapp needs three.
    """
    p = 0.5 + level / 2
    variance, of_ci, of_pi = 1 / weight, NormalDist().inv_cdf(p), NormalDist().inv_cdf(p)
    if hartung_knapp and k >= 3:
        variance *= max(1.0, spread / (k - 1))
        of_ci, of_pi = t_quantile(p, k - 1), t_quantile(p, k - 2)
    ci, pi = of_ci * sqrt(variance), of_pi * sqrt(variance + tau2)
    return tau2, effect, sqrt(variance), effect - ci, effect + ci, effect - pi, effect + pi


_FIELDS = ("tau2", "effect", "se", "ci_low", "ci_high", "pi_low", "pi_high")
_RESULT = "k long, " + ", ".join(f"{c} double" for c in _FIELDS) + ", refusal string"


def _analyse_bucket(level: float):
    def analyse(rows: pd.DataFrame) -> pd.DataFrame:
        """The strata of a bucket; those of one size go together."""
        rows = rows.sort_values(["k", "stratum", "study"])
        out = []
        for k, same in rows.groupby("k", sort=False):
            y, v = (same[c].to_numpy().reshape(-1, k) for c in ("y", "v"))
            names = same["stratum"].to_numpy()[::k]
            for part in np.array_split(np.arange(len(y)), max(1, -(-y.size // BLOCK))):
                tau2 = reml_tau2s(y[part], v[part])
                w = 1 / (v[part] + tau2[:, None])
                weight = w.sum(axis=1)
                mean = (w * y[part]).sum(axis=1) / weight
                spread = (w * (y[part] - mean[:, None]) ** 2).sum(axis=1)
                out += [(names[i], k, *analysed(k, *map(float, x), level), None) for i, *x in zip(part.tolist(), tau2, weight, mean, spread, strict=True)]
        return pd.DataFrame(out, columns=["stratum", "k", *_FIELDS, "refusal"])

    return analyse


def _analyse_large(rows: DataFrame, kind: str, level: float) -> DataFrame:
    """The strata of ``rows`` (stratum, y, v), whose studies no task has to hold: sums at each tau2 are aggregates.

    There are fewer of them than rows / ``most``. Each round asks for the sums at some tau2 of every stratum: first at
    the grid, then between the neighbours of each peak, until they meet.
    """
    spark = rows.sparkSession
    told = rows.groupBy("stratum").agg(F.count("*").alias("k"), F.avg("y").alias("mid"), F.min("v").alias("low"), F.greatest(F.max("v"), F.pow(F.max("y") - F.min("y"), F.lit(2))).alias("high")).collect()
    mid, ks = ({r["stratum"]: r[c] for r in told} for c in ("mid", "k"))

    def sums(asked: dict[object, np.ndarray]) -> dict[object, np.ndarray]:
        """Of each stratum, for each tau2: sums of w, w y, w y^2 and log w, y about its middle."""
        held = spark.sparkContext.broadcast((asked, mid))

        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tau2s, mids = held.value
            whole: dict[object, np.ndarray] = {}
            for batch in batches:
                for name, part in batch.groupby("stratum"):
                    tau2 = tau2s[name]
                    got = whole.setdefault(name, np.zeros((4, len(tau2))))
                    for at in range(0, len(part), 1000):
                        y, v = (part[c].to_numpy()[at : at + 1000, None] for c in ("y", "v"))
                        y = y - mids[name]
                        w = 1 / (v + tau2[None, :])
                        got += np.stack([w.sum(axis=0), (w * y).sum(axis=0), (w * y * y).sum(axis=0), np.log(w).sum(axis=0)])
            for name, got in whole.items():
                yield pd.DataFrame({"stratum": name, "i": range(got.shape[1]), **dict(zip("abcd", got, strict=True))})

        parts = rows.mapInPandas(added, f"stratum {kind}, i int, a double, b double, c double, d double").groupBy("stratum", "i").agg(*(F.sum(x).alias(x) for x in "abcd"))
        out = {name: np.zeros((4, len(t))) for name, t in asked.items()}
        for r in parts.collect():
            out[r["stratum"]][:, r["i"]] = r["a"], r["b"], r["c"], r["d"]
        return out

    def profile(s: np.ndarray) -> np.ndarray:
        return -0.5 * (-s[3] + np.log(s[0]) + s[2] - s[1] ** 2 / s[0])

    grids = {r["stratum"]: _grid(np.array([r["low"]]), np.array([r["high"]]))[0] for r in told}
    spans, best = {}, {}
    for name, s in sums(grids).items():
        value = profile(s)
        best[name] = (value[0], 0.0)
        spans[name] = [(grids[name][i - 1], grids[name][min(i + 1, len(value) - 1)]) for i in _peaks(value[None, :], ks[name])[1].tolist()]
    for _ in range(ROUNDS if told else 0):
        asked = {name: np.concatenate([np.linspace(a, b, POINTS) for a, b in x]) if x else np.zeros(1) for name, x in spans.items()}
        for name, s in sums(asked).items():
            for j in range(len(spans[name])):
                at, value = asked[name][j * POINTS : (j + 1) * POINTS], profile(s)[j * POINTS : (j + 1) * POINTS]
                i = int(np.argmax(value))
                spans[name][j] = (at[max(0, i - 1)], at[min(POINTS - 1, i + 1)])
                best[name] = max(best[name], (float(value[i]), float(at[i])), key=lambda x: x[0])
    last = sums({name: np.array([t]) for name, (_, t) in best.items()}) if told else {}
    out = []
    for r in told:
        a, b, c, _ = last[r["stratum"]][:, 0].tolist()
        out.append((r["stratum"], r["k"], *analysed(r["k"], best[r["stratum"]][1], a, r["mid"] + b / a, max(0.0, c - b * b / a), level), None))
    return spark.createDataFrame(out, f"stratum {kind}, {_RESULT}")


def random_effects(estimates: DataFrame, stratum: str, study: str, effect: Column, variance: Column, order: list[str], level: float = 0.95, most: int = 100_000) -> DataFrame:
    """One row a stratum: k studies, tau2, effect, its interval and the prediction interval, or a refusal.

    The first estimate of each study by ``order`` (total) counts, if finite with a variance above 0. A stratum of one
    study is refused. Strata of up to ``most`` studies are dealt to tasks, BUCKET studies as a mean; larger ones are
    summed up over all tasks (see :func:`_analyse_large`), so no stratum is refused or cut for its size.
    """
    key = F.struct(*order)
    rows = estimates.select(F.col(stratum).alias("stratum"), F.col(study).alias("study"), key.alias("_by"), effect.cast("double").alias("y"), variance.cast("double").alias("v"))
    rows = rows.where("y is not null and not isnan(y) and abs(y) < double('infinity') and v > 0 and v < double('infinity')")
    first = written(rows.groupBy("stratum", "study").agg(F.min_by(F.struct("y", "v"), "_by").alias("e")).select("stratum", "study", "e.y", "e.v"), "estimates")
    size = written(first.groupBy("stratum").agg(F.count("*").alias("k")), "strata")
    kind = first.schema["stratum"].dataType.simpleString()
    total, large = size.agg(F.coalesce(F.sum("k"), F.lit(0)), F.count_if(F.col("k") > most)).first()
    dealt = first.join(size.where(F.col("k").between(2, most)), "stratum").withColumn("bucket", F.pmod(F.xxhash64("stratum"), F.lit(max(1, -(-total // BUCKET)))))
    done = dealt.groupBy("bucket").applyInPandas(_analyse_bucket(level), f"stratum {kind}, {_RESULT}")
    if large:
        done = done.unionByName(_analyse_large(first.join(F.broadcast(size.where(F.col("k") > most).select("stratum")), "stratum", "left_semi"), kind, level))
    refused = size.where("k < 2").select("stratum", "k", *(F.lit(None).cast("double").alias(c) for c in _FIELDS), F.lit("one_study").alias("refusal"))
    return done.unionByName(refused)
