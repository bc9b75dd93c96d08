"""Multivariate statistics of a (scene, phase, metric) cube.

Spark reduces the cube to sufficient statistics in one aggregation: counts, sums and cross products by phase, and of scene
means. The K x K algebra that follows runs in the driver on those few numbers.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellmill.functions.fdist import f_sf

FAIL_CONDITION = 1000.0
WARN_CONDITION = 30.0


class StatsError(ValueError):
    """A cube that the test can't be made on."""


def standardise(cells: DataFrame, metrics: list[str], lower_is_better: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """z-scores over all cells, or those of a group (population deviation; constant columns become 0), turned so that higher is better."""
    stats = cells.groupBy(*by).agg(*[F.avg(m).alias(f"__a_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"__s_{m}") for m in metrics])
    sign = lambda m: -1.0 if m in lower_is_better else 1.0
    z = lambda m: F.when(F.col(f"__s_{m}") > 0, (F.col(m) - F.col(f"__a_{m}")) / F.col(f"__s_{m}") * sign(m)).otherwise(F.lit(0.0))
    rest = [c for c in cells.columns if c not in metrics]
    joined = cells.join(stats, list(by)) if by else cells.crossJoin(F.broadcast(stats))  # one row of statistics
    return joined.select(*rest, *[z(m).alias(m) for m in metrics])


def sscp(df: DataFrame, metrics: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """n, sums s_<m> and cross products p_<a>_<b> of metrics, by keys."""
    pairs = list(combinations_with_replacement(metrics, 2))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(f"s_{m}") for m in metrics], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs])


def _moments(row, metrics: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    k = len(metrics)
    cross = np.zeros((k, k))
    for (i, a), (j, b) in combinations_with_replacement(list(enumerate(metrics)), 2):
        cross[i, j] = cross[j, i] = row[f"p_{a}_{b}"]
    return row["n"], np.array([row[f"s_{m}"] for m in metrics], float), cross


@dataclass
class Cube:
    """Sufficient statistics of standardised cells: per phase, and of scene means."""

    phases: list
    n_scenes: int
    means: np.ndarray
    within: np.ndarray
    between: np.ndarray
    scene: np.ndarray

    @classmethod
    def of(cls, z: DataFrame, metrics: list[str], scene: str = "scene", phase: str = "phase") -> Cube:
        by_scene = z.groupBy(scene).agg(*[F.avg(m).alias(m) for m in metrics])
        return cls._from(sscp(z, metrics, (phase,)).collect(), sscp(by_scene, metrics).first(), metrics, phase)

    @classmethod
    def of_each(cls, z: DataFrame, metrics: list[str], group: str, scene: str = "scene", phase: str = "phase") -> dict[str, Cube]:
        """A cube for every value of a column (a small set), from two aggregations of all of them."""
        by_scene = z.groupBy(group, scene).agg(*[F.avg(m).alias(m) for m in metrics])
        scenes = {r[group]: r for r in sscp(by_scene, metrics, (group,)).collect()}
        phases: dict[str, list] = {}
        for r in sscp(z, metrics, (group, phase)).collect():
            phases.setdefault(r[group], []).append(r)
        return {g: cls._from(rows, scenes[g], metrics, phase) for g, rows in sorted(phases.items())}

    @classmethod
    def _from(cls, by_phase: list, of_scenes, metrics: list[str], phase: str) -> Cube:
        """of_scenes may be None where only one-way tests follow."""
        rows = sorted(by_phase, key=lambda r: str(r[phase]))
        moments = [_moments(r, metrics) for r in rows]
        if len(rows) < 2 or moments[0][0] < 2:
            raise StatsError("at least two phases and two scenes are needed")
        if len({n for n, _, _ in moments}) > 1:
            raise StatsError("the cube is not balanced: keep complete scenes only")
        n = moments[0][0]
        means = np.array([s / n for _, s, _ in moments])
        within = sum(c - np.outer(s, s) / n for _, s, c in moments)
        grand = means.mean(axis=0)
        between = n * (means - grand).T @ (means - grand)
        scenes = np.zeros_like(within)
        if of_scenes is not None:
            _, s, c = _moments(of_scenes, metrics)
            scenes = len(rows) * (c - np.outer(s, s) / n)
        return cls([r[phase] for r in rows], n, means, within, between, scenes)


def rao_f(wilks: float, k: int, q: int, v: float, whole: bool) -> tuple[float, float, float]:
    """Rao's approximation of Wilks' lambda; v is its error term, `whole` rounds the second degrees of freedom."""
    low = k * k + q * q - 5
    t = math.sqrt((k * k * q * q - 4) / low) if low > 0 and k * k * q * q > 4 else 1.0
    df1, df2 = float(k * q), v * t - (k * q - 2) / 2
    if whole:
        df2 = float(round(df2)) if round(df2) > 0 else max(df1, 1.0)
    elif df2 <= 0:
        raise StatsError("no degrees of freedom are left")
    root = wilks ** (1 / t) if wilks > 0 else 0.0
    f = math.inf if root <= 0 else max(0.0, (1 - root) / root * df2 / df1)
    return f, df1, df2


@dataclass
class Phi:
    phi_wilks: float
    phi_pillai: float
    wilks: float
    pillai: float
    f: float
    df1: float
    df2: float
    p_value: float
    n_scenes: int
    k: int


def _phi(h: np.ndarray, e: np.ndarray, q: int, v: float, n: int, whole: bool) -> Phi:
    k = len(e)
    s = max(1, min(k, q))
    if np.linalg.norm(h) <= 1e-12 * max(1.0, np.linalg.norm(e)):
        f, df1, df2 = rao_f(1.0, k, q, v, whole)
        return Phi(1.0, 1.0, 1.0, 0.0, 0.0, df1, df2, 1.0, n, k)
    sign_e, log_e = np.linalg.slogdet(e)
    sign_t, log_t = np.linalg.slogdet(h + e)
    if sign_e <= 0 or sign_t <= 0 or not math.isfinite(log_e):
        raise StatsError("singular: metrics are constant or combinations of each other, or there are too few scenes")
    wilks = math.exp(log_e - log_t)
    pillai = float(np.trace(np.linalg.solve(h + e, h)))
    f, df1, df2 = rao_f(wilks, k, q, v, whole)
    clip = lambda x: min(1.0, max(0.0, float(x)))
    return Phi(clip(wilks ** (1 / s)), clip(1 - pillai / s), wilks, pillai, f, df1, df2, f_sf(f, df1, df2), n, k)


def phi_oneway(cube: Cube) -> Phi:
    """Phase effect with the scenes' own variance left in the error."""
    k, q = len(cube.within), len(cube.phases) - 1
    condition = np.linalg.cond(cube.within) if k > 1 else 1.0
    if not np.isfinite(condition) or condition > FAIL_CONDITION:
        raise StatsError(f"collinear metrics: condition {condition:.3g}")
    return _phi(cube.between, cube.within, q, cube.n_scenes - 1 - (k + q + 1) / 2, cube.n_scenes, True)


def phi_repeated(cube: Cube) -> Phi:
    """Phase effect after scenes' means are taken out, as in a repeated-measures design."""
    k, q = len(cube.within), len(cube.phases) - 1
    error = cube.within - cube.scene
    df_e = (cube.n_scenes - 1) * q
    return _phi(cube.between, error, q, df_e - (k - q + 1) / 2, cube.n_scenes, False)


def interpretation(phi: Column) -> Column:
    """Effect size in words."""
    return F.when(phi > 0.99, "negligible").when(phi > 0.94, "small").when(phi > 0.86, "medium").otherwise("large")


def differences(cells: DataFrame, metrics: list[str], first: str, second: str, scene: str = "scene", phase: str = "phase") -> DataFrame:
    """second - first of every metric for scenes that have both phases."""
    at = lambda m, p: F.max(F.when(F.col(phase) == p, F.col(m)))
    both = cells.filter(F.col(phase).isin(first, second)).groupBy(scene).agg(*[(at(m, second) - at(m, first)).alias(m) for m in metrics])
    return both.dropna("any", subset=metrics)


def hotelling(n: int, mean: np.ndarray, cov: np.ndarray) -> dict[str, float]:
    """One-sample test of paired differences."""
    k = len(mean)
    if n <= k:
        raise StatsError("more scenes than metrics are needed")
    if np.abs(cov).max() <= 1e-24 and np.abs(mean).max() <= 1e-12:
        t2 = 0.0
    else:
        try:
            t2 = float(n * mean @ np.linalg.solve(cov, mean))
        except np.linalg.LinAlgError as e:
            raise StatsError("singular covariance") from e
    f = (n - k) / ((n - 1) * k) * t2
    return {"n": n, "t2": t2, "f": f, "p_value": f_sf(f, k, n - k), "phi": 1 - t2 / (t2 + n - 1)}


def hotelling_of(diffs: DataFrame, metrics: list[str]) -> dict[str, float]:
    n, s, c = _moments(sscp(diffs, metrics).first(), metrics)
    return hotelling(n, s / n, (c - np.outer(s, s) / n) / (n - 1))


def holm(df: DataFrame, p: str = "p_value", out: str = "p_holm", by: tuple[str, ...] = (), *ties: str) -> DataFrame:
    """Step-down adjusted p-values within groups (families are small)."""
    order = W.partitionBy(*by).orderBy(p, *ties)
    m = F.count(F.lit(1)).over(W.partitionBy(*by))
    stepped = df.withColumn("__a", (m - F.row_number().over(order) + 1) * F.col(p))
    running = F.max("__a").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return stepped.withColumn(out, F.least(running, F.lit(1.0))).drop("__a")


def transitions(z: DataFrame, metrics: list[str], phases: tuple[str, ...]) -> DataFrame:
    """Hotelling tests of all three phase transitions with adjusted p-values."""
    pairs = [(phases[0], phases[1]), (phases[1], phases[2]), (phases[0], phases[2])]
    rows = [{"transition": f"{a}->{b}", **hotelling_of(differences(z, metrics, a, b), metrics)} for a, b in pairs]
    return holm(z.sparkSession.createDataFrame(rows), "p_value", "p_holm", (), "transition")


def contrasts(z: DataFrame, metrics: list[str], phases: tuple[str, ...], keep: tuple[str, ...] = (), scene: str = "scene") -> tuple[DataFrame, list[str]]:
    """Two orthonormal phase contrasts of every metric per scene."""
    r2, r6 = math.sqrt(2), math.sqrt(6)
    weights = [(-1 / r2, 1 / r2, 0.0), (-1 / r6, -1 / r6, 2 / r6)]
    at = lambda m, p: F.max(F.when(F.col("phase") == p, F.col(m)))
    columns = {f"{m}_{i}": sum((at(m, p) * w for p, w in zip(phases, ws)), F.lit(0.0)) for i, ws in enumerate(weights) for m in metrics}
    return z.groupBy(scene, *keep).agg(*[c.alias(n) for n, c in columns.items()]), list(columns)


def _groups(df: DataFrame, metrics: list[str], group: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Between and within matrices, grand mean, n and number of groups."""
    parts = [_moments(r, metrics) for r in sscp(df, metrics, (group,)).collect()]
    n = sum(p[0] for p in parts)
    grand = sum(p[1] for p in parts) / n
    within = sum(c - np.outer(s, s) / m for m, s, c in parts)
    between = sum(m * np.outer(s / m - grand, s / m - grand) for m, s, _ in parts)
    return between, within, grand, n, len(parts)


def mixed_design(z: DataFrame, metrics: list[str], phases: tuple[str, ...], tier: str = "tier") -> DataFrame:
    """Phase (within scenes), tier (between scenes) and their interaction: one row per effect."""
    flat, names = contrasts(z, metrics, phases, (tier,))
    between, within, grand, n, groups = _groups(flat, names, tier)
    if groups < 2:
        raise StatsError("at least two tiers are needed")
    k = len(metrics)
    v = lambda dim, q: n - 1 - (dim + q + 1) / 2
    effects = {"phase": _phi(n * np.outer(grand, grand), within, 1, v(len(names), 1), n, True), "interaction": _phi(between, within, groups - 1, v(len(names), groups - 1), n, True)}
    means = z.groupBy("scene", tier).agg(*[F.avg(m).alias(m) for m in metrics])
    between, within, _, n, groups = _groups(means, metrics, tier)
    effects["tier"] = _phi(between, within, groups - 1, v(k, groups - 1), n, True)
    return z.sparkSession.createDataFrame([{"effect": name, **asdict(phi)} for name, phi in effects.items()])


def phi_interaction(z: DataFrame, metrics: list[str], phases: tuple[str, ...], tier: str = "tier") -> Phi:
    """Phase by tier, after scenes and phases are taken out (three phases): the nested models differ by the tiers' means of the
    two phase contrasts."""
    flat, names = contrasts(z, metrics, phases, (tier,))
    between = within = 0.0
    n = groups = 0
    for i in range(2):
        mine = [c for c in names if c.endswith(f"_{i}")]
        h, e, _, n, groups = _groups(flat, mine, tier)
        between, within = between + h, within + e
    k, q = len(metrics), 2 * (groups - 1)
    df_e = 2 * (n - groups)
    return _phi(between, within, q, df_e - (k - q + 1) / 2, n, False)


def phi_table(spark, results: dict[str, Phi]) -> DataFrame:
    rows = spark.createDataFrame([{"design": name, **asdict(phi)} for name, phi in results.items()])
    return rows.withColumn("effect_size", interpretation(F.col("phi_wilks")))


def poisson_steps(most: int = 8) -> list[float]:
    """Shares of Poisson(1) draws that are 0 or less, 1 or less, and so on; beyond `most` the chance is under 1e-6."""
    out, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
    return out


def _replicated(sums: DataFrame, replicates: int, seed: str, unit: str) -> DataFrame:
    """sums (a row for each unit and group) for every replicate, with times: how often the row's unit is drawn in it, a Poisson(1) draw from the hash of
    both, the same in any order. A unit's rows, as many as there are groups, travel together, so that its hash is made once a replicate. The hash is
    a column of its own, and no row is filtered out, which would make it twice."""
    text = F.concat_ws(":", F.lit(seed), F.col("replicate").cast("string"), F.col(unit).cast("string"))
    share = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    parts = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows grow to many, so they are not put into one task for being few
    together = sums.repartition(parts, unit).groupBy(unit).agg(F.collect_list(F.struct(*[c for c in sums.columns if c != unit])).alias("__rows"))
    drawn = together.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("__share", share)
    times = sum((F.when(F.col("__share") >= step, 1).otherwise(0) for step in poisson_steps()), F.lit(0))
    return drawn.select("replicate", times.alias("times"), F.explode("__rows").alias("__row")).select("replicate", "times", "__row.*")


def bootstrap_means(df: DataFrame, value: str, unit: str, replicates: int = 2000, by: tuple[str, ...] = (), seed: str = "boot") -> DataFrame:
    """Mean of every bootstrap replicate. A unit's rows are drawn together, so they are summed first; there is no index of all rows."""
    sums = df.groupBy(*by, unit).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("__s"), F.count(value).alias("__n"))
    drawn = _replicated(sums, replicates, seed, unit)
    return drawn.groupBy(*by, "replicate").agg((F.sum(F.col("__s") * F.col("times")) / F.nullif(F.sum(F.col("__n") * F.col("times")), F.lit(0))).alias("mean"))


def bootstrap_phi(z: DataFrame, metrics: list[str], replicates: int = 1000, level: float = 0.95, seed: str = "phi", least: float = 0.5, scene: str = "scene", phase: str = "phase") -> DataFrame:
    """Spread of the one-way phase effect over scenes drawn anew: means, percentile limits, standard errors, and how many draws gave none. A scene's
    cells are drawn together. Sums of a scene and phase are made once, those of every replicate in one aggregation; the driver gets a row a replicate and phase."""
    if not 0 < level < 1 or replicates < 50:
        raise StatsError("the level must lie in (0, 1), and at least 50 replicates are needed")
    pairs = list(combinations_with_replacement(metrics, 2))
    t = F.col("times")
    own = z.groupBy(scene, phase).agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(f"s_{m}") for m in metrics], *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs])
    sums = [F.sum(t * F.col(c)).alias(c) for c in own.columns[2:]]
    rows = _replicated(own, replicates, seed, scene).groupBy("replicate", phase).agg(*sums).collect()
    drawn: dict[int, list] = {}
    for r in rows:
        drawn.setdefault(r.replicate, []).append(r)
    found = []
    for k in sorted(drawn):
        try:
            found.append(phi_oneway(Cube._from(drawn[k], None, metrics, phase)))
        except (StatsError, np.linalg.LinAlgError):
            continue
    if len(found) < int(least * replicates):
        raise StatsError(f"only {len(found)} of {replicates} draws could be tested")
    out: dict[str, float | int] = {}
    tails = [100 * (1 - level) / 2, 100 * (1 + level) / 2]
    for name in ("phi_wilks", "phi_pillai"):
        values = np.array([getattr(p, name) for p in found])
        low, high = np.percentile(values, tails)
        out |= {f"{name}_mean": float(values.mean()), f"{name}_low": float(low), f"{name}_high": float(high), f"{name}_se": float(values.std(ddof=1)) if len(values) > 1 else 0.0}
    out |= {"n_boot": replicates, "n_success": len(found), "n_failed": replicates - len(found)}
    return z.sparkSession.createDataFrame([out])


def mean_ci(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, median, deviation, percentiles and the normal 95 % interval; all 0 for no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n"), zero(F.avg(value)).alias("mean"), zero(F.median(value)).alias("median"), zero(F.stddev_samp(value)).alias("std"),
        zero(F.percentile(value, 0.05)).alias("p5"), zero(F.percentile(value, 0.95)).alias("p95"),
    )
    half = 1.96 * F.col("std") / F.sqrt(F.greatest("n", F.lit(1)))
    return out.withColumn("ci95_low", F.col("mean") - half).withColumn("ci95_high", F.col("mean") + half)


def degradation(cells: DataFrame, value: str, budget: str = "frame_budget", by: tuple[str, ...] = (), lower_is_better: bool = True, tol: float = 0.05) -> DataFrame:
    """Temporal gain, normalised area under the budget curve and smallest budget within tol of the largest one's mean."""
    curve = cells.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, budget).agg(F.avg(value).alias("v"))
    w = W.partitionBy(*by).orderBy(budget)
    steps = curve.withColumn("area", (F.lead(budget).over(w) - F.col(budget)) * (F.lead("v").over(w) + F.col("v")) / 2)
    ends = steps.groupBy(*by).agg(
        F.min_by("v", budget).alias("v_min"), F.max_by("v", budget).alias("v_max"), F.sum("area").alias("area"), (F.max(budget) - F.min(budget)).alias("range"),
        F.array_sort(F.collect_list(F.struct(F.col(budget).alias("b"), "v"))).alias("points"),
    )
    near = F.filter("points", lambda p: F.abs(p["v"] - F.col("v_max")) <= tol * F.abs("v_max"))
    gain = F.col("v_min") - F.col("v_max") if lower_is_better else F.col("v_max") - F.col("v_min")
    some = (F.abs("v_max") > 1e-12) & (F.col("range") > 0)
    return ends.select(*by, gain.alias("tcv"), F.when(some, F.col("area") / (F.col("range") * F.abs("v_max"))).alias("audc"), F.when(F.abs("v_max") >= 1e-12, F.try_element_at(near, F.lit(1))["b"]).alias("critical_budget"))


def wilcoxon(pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Signed-rank statistic of b - a with its normal approximation; zero differences are dropped, ties share their mean rank."""
    d = pairs.select(*by, (F.col(b) - F.col(a)).alias("d")).filter("d <> 0")
    sizes = d.withColumn("m", F.abs("d")).groupBy(*by, "m").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    w = W.partitionBy(*by).orderBy("m").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = sizes.withColumn("r", F.sum("c").over(w) - (F.col("c") - 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum(F.col("r") * F.col("up")).alias("w_plus"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return out.select(*by, "n", "w_plus", F.when(sd > 0, (F.col("w_plus") - n * (n + 1) / 4) / sd).alias("z"))
