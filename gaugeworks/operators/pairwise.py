"""Pairwise strength models with bootstrap replicates.

Without covariates a fit needs only the number of battles per model and score,
so replicates are multinomial draws over those cells.  With covariates the
design rows stay distributed and hold a model name and a few dense columns, never
a column per model.  The curvature of such a fit is an arrowhead: a diagonal over
the models, a border of models by dense columns and a small dense block.  Each
Newton step is one pass in which every task adds up these parts for all
replicates; the parts meet per replicate, where the step is solved by the Schur
complement of the diagonal.  Only the steps come back to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised

_MAX_STEPS = 50
_TOLERANCE = 1e-9
_CLIP = 1e-12
_FLAT = 1e-6
_BUCKETS, _CHUNK = 1_024, 20_000  # of the rows by their hash; rows weighed at once


# ---- without covariates ------------------------------------------------------


def strength(mean: Column) -> Column:
    """Closed form of the logistic fit of one model against the baseline."""
    p = F.greatest(F.least(mean, F.lit(1 - _CLIP)), F.lit(_CLIP))
    return F.log(p / (1 - p))


def win_probability(coef: Column, baseline: Column | float = 0.0) -> Column:
    base = F.lit(baseline) if isinstance(baseline, float) else baseline
    return F.exp(coef) / (F.exp(coef) + F.exp(base))


def coefficients(cells: DataFrame, strata: list[str] = ()) -> DataFrame:
    """Strength of each model against the baseline at 0, from score cells."""
    mean = F.sum(F.col("scores") * F.col("n")) / F.sum("n")
    return cells.groupBy(*strata, "model").agg(strength(mean).alias("coef"))


def _rk_terms(z, eta, outcome):
    """Loss per battle of the tie model and its derivatives in z and eta."""
    s = np.where(outcome == 0, -1.0, 1.0)
    zz = s * z
    w, lo = 1 / (1 + np.exp(-(zz - eta))), 1 / (1 + np.exp(zz + eta))
    tie = outcome == 0.5
    p = np.where(tie, 1 - w - lo, w) + 1e-10
    dw, dl = w * (1 - w), lo * (1 - lo)
    dp_z = np.where(tie, -dw + dl, dw) * s
    dp_eta = np.where(tie, dw + dl, -dw)
    return -np.log(p), -dp_z / p, -dp_eta / p


def _fit_rk(index, outcome, weight, n_models):
    """Tie model on weighted cells: strengths, tie width, and whether the fit converged."""
    total = weight.sum()

    def value_and_gradient(theta):
        loss, dz, de = _rk_terms(theta[index], theta[-1], outcome)
        g = np.zeros(n_models + 1)
        np.add.at(g, index, weight * dz)
        g[-1] = (weight * de).sum()
        return (weight * loss).sum() / total, g / total

    theta = np.full(n_models + 1, 0.0)
    theta[-1] = 0.1
    value, grad = value_and_gradient(theta)
    eye = np.eye(n_models + 1)
    for _ in range(_MAX_STEPS):
        if np.abs(grad).max() < _TOLERANCE:
            break
        h = 1e-5
        curvature = np.array([(value_and_gradient(theta + h * e)[1] - grad) / h for e in eye])
        curvature = (curvature + curvature.T) / 2
        low = np.linalg.eigvalsh(curvature)[0]
        if low < 1e-8:
            curvature += (1e-8 - low) * eye
        step = np.linalg.solve(curvature, grad)
        size = 1.0
        while size > 1e-8:
            new_value, new_grad = value_and_gradient(theta - size * step)
            if new_value <= value:
                break
            size /= 2
        if size <= 1e-8 or value - new_value < 1e-15:
            break
        theta, value, grad = theta - size * step, new_value, new_grad
    # no further descent in double precision counts, a fit that ran out of steps does not
    return theta, bool(np.abs(grad).max() < _FLAT)


def tie_model(
    cells: DataFrame, strata: list[str] = (), *, n_bootstrap: int = 0, seed: int = 0
) -> DataFrame:
    """Tie model per stratum; replicate 0 is the fit on the data itself.

    Each stratum is a small table of counts (three scores per model).  Resampling
    is over all battles of the stratum, replicates are spread over tasks.
    """
    keys = list(strata)
    packed = cells.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("model", "scores", "n"))).alias("__c")
    ).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap))))
    packed = packed.select(
        *keys, "replicate",
        F.xxhash64(F.lit(seed), *keys, "replicate").alias("__seed"),
        F.col("__c.model").alias("__m"), F.col("__c.scores").alias("__s"), F.col("__c.n").alias("__n"),
    ).repartition(*keys, "replicate")

    def fit(batches):
        for pdf in batches:
            parts = []
            for row in pdf.itertuples(index=False):
                models, index = np.unique(np.asarray(row[-3], str), return_inverse=True)
                outcome, counts = np.asarray(row[-2], float), np.asarray(row[-1], np.int64)
                replicate = row[len(keys)]
                if replicate:
                    rng = np.random.default_rng(row[-4] & 0xFFFFFFFFFFFFFFFF)
                    counts = rng.multinomial(counts.sum(), counts / counts.sum())
                theta, converged = _fit_rk(index, outcome, counts.astype(float), len(models))
                part = pd.DataFrame(dict(zip(keys, row)), index=range(len(models)))
                part["replicate"], part["model"] = replicate, models
                part["coef"], part["eta"], part["converged"] = theta[:-1], theta[-1], converged
                parts.append(part)
            if parts:
                yield pd.concat(parts, ignore_index=True)

    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = "".join(f"`{k}` {types[k]}, " for k in keys)
    return packed.mapInPandas(fit, schema + "replicate INT, model STRING, coef DOUBLE, eta DOUBLE, converged BOOLEAN")


# ---- with covariates ---------------------------------------------------------


def style_features(
    battles: DataFrame, metadata: DataFrame, baseline: str, counts: list[str]
) -> DataFrame:
    """Standardised style differences of target and baseline answer.

    ``metadata`` has uid, model, ``length`` and the markdown counts.  The first
    feature is the relative length difference, the others compare densities.
    """
    m = metadata.select("uid", "model", "length", *counts)
    t = m.select("uid", "model", *[F.col(c).cast("double").alias(f"__t_{c}") for c in ("length", *counts)])
    b = m.filter(F.col("model") == baseline).select(
        "uid", *[F.col(c).cast("double").alias(f"__b_{c}") for c in ("length", *counts)]
    )
    joined = battles.join(t, ["uid", "model"]).join(b, "uid")
    raw = {
        "length": (F.col("__t_length") - F.col("__b_length"))
        / (F.col("__t_length") + F.col("__b_length"))
    }
    for c in counts:
        dt = F.col(f"__t_{c}") / (F.col("__t_length") + 1)
        db = F.col(f"__b_{c}") / (F.col("__b_length") + 1)
        raw[c] = (dt - db) / (dt + db + 1)
    named = joined.select(*battles.columns, *[v.alias(f"__f_{k}") for k, v in raw.items()])
    stats = named.agg(
        *[F.avg(f"__f_{k}").alias(f"m_{k}") for k in raw],
        *[F.stddev_samp(f"__f_{k}").alias(f"s_{k}") for k in raw],
    ).first()  # one row
    return named.select(
        *battles.columns,
        *[
            ((F.col(f"__f_{k}") - F.lit(stats[f"m_{k}"])) / F.lit(stats[f"s_{k}"])).alias(f"f_{k}")
            for k in raw
        ],
    )


def design_columns(models: list[str], baseline: str) -> list[Column]:
    """One column per model: +1 for the row's model, -1 for the baseline."""
    return [
        (F.lit(-1.0) if m == baseline else F.when(F.col("model") == m, 1.0).otherwise(0.0)).alias(f"x_{i}")
        for i, m in enumerate(models)
    ]


def design(
    battles: DataFrame, features: list[str], baseline: str, *, outcome: str = "scores"
) -> tuple[DataFrame, list[str]]:
    """Design rows with equal ones counted together, and the names of the coefficients.

    A row names its model in ``m``; ``x`` has the style columns only.  All models keep
    a coefficient of their own next to the chosen style columns.
    """
    found = sorted({r[0] for r in battles.select("model").distinct().collect()} | {baseline})
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = battles.select(F.col("model").alias("m"), x.alias("x"), F.col(outcome).cast("double").alias("y"))
    return rows.groupBy("m", "x", "y").agg(F.count(F.lit(1)).alias("n")), [*found, *features]


class _Sums:
    """Gradient and arrowhead curvature of all replicates over the rows of a task.

    Kept per replicate in one row: gradient (models, then dense columns), diagonal,
    border (models by dense columns) and dense block.
    """

    def __init__(self, fits: int, models: int, dense: int):
        self.models, self.dense = models, dense
        self.bounds = np.cumsum([models + dense, models, models * dense, dense * dense])
        self.total = np.zeros((fits, self.bounds[-1]))

    def parts(self):
        """Views of gradient, diagonal, border and block."""
        g, d, border, block = np.split(self.total, self.bounds[:-1], axis=1)
        fits = len(self.total)
        return g, d, border.reshape(fits, self.models, self.dense), block.reshape(fits, self.dense, self.dense)

    def add(self, m, x, y, w, beta) -> None:
        """Rows with model index ``m`` (-1: none), dense columns, outcome and a weight per fit."""
        g, diagonal, border, block = self.parts()
        z = x @ beta[:, self.models:].T
        own = m >= 0
        z[own] += beta[:, m[own]].T
        p = 1 / (1 + np.exp(-z))
        gap, curve = w * (p - y[:, None]), w * p * (1 - p)
        g[:, self.models:] += gap.T @ x
        block += (curve.T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)).reshape(block.shape)
        if own.any():
            order = np.flatnonzero(own)[np.argsort(m[own], kind="stable")]
            ids, starts = np.unique(m[order], return_index=True)
            g[:, ids] += np.add.reduceat(gap[order], starts).T
            diagonal[:, ids] += np.add.reduceat(curve[order], starts).T
            for c in range(self.dense):
                border[:, ids, c] += np.add.reduceat(curve[order] * x[order, c: c + 1], starts).T

    def steps(self, beta: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        """Newton step per fit; models without a row in a resample stay where they are."""
        g, diagonal, border, block = self.parts()
        g = g + penalty * beta
        diagonal = diagonal + penalty[: self.models]
        block = block + np.diag(penalty[self.models:])
        with np.errstate(divide="ignore"):
            inverse = np.where(diagonal > 0, 1 / diagonal, 0.0)
        g_models, g_dense = g[:, : self.models], g[:, self.models:]
        scaled = border * inverse[:, :, None]
        left = block - np.einsum("bmi,bmj->bij", border, scaled)
        right = g_dense - np.einsum("bmi,bm->bi", scaled, g_models)
        dense = np.einsum("bij,bj->bi", np.linalg.pinv(left, hermitian=True, rcond=1e-12), right)
        models = inverse * (g_models - np.einsum("bmi,bi->bm", border, dense))
        return np.hstack([models, dense])


def _draws(sizes: np.ndarray, left: np.ndarray, weight: int, rng) -> np.ndarray:
    """Share of every fit's draws that falls to the next rows, of ``weight`` rows that are left in a bucket."""
    return rng.binomial(left, min(1.0, sizes.sum() / weight)) if weight > sizes.sum() else left.copy()


def logistic_bootstrap(
    rows: DataFrame,
    names: list[str],
    *,
    baseline: str | None = None,
    n_bootstrap: int = 100,
    seed: int = 0,
    intercept: bool = False,
    l2: float = 0.0,
    max_steps: int = _MAX_STEPS,
) -> pd.DataFrame:
    """Logistic fits on all rows (replicate 0) and on exact resamples.

    ``rows`` has ``x`` (array), ``y`` in [0, 1] and ``n``, and with a ``baseline`` the
    model ``m``: then ``names`` lists the models before the columns of ``x``, a row has
    +1 for its model and -1 for the baseline, and strengths are given with mean zero
    unless they are penalised.  The result is bounded by replicates times
    coefficients.  ``l2`` penalises all but the intercept.  A resample is drawn per
    bucket of the rows' hash, in the order of the rows, so it depends on the rows and
    the seed alone, never on partitions or batches.  ``converged`` tells whether the
    last step of a replicate was below the tolerance.
    """
    spark = rows.sparkSession
    if "m" not in rows.columns:
        rows = rows.withColumn("m", F.lit(None).cast("string"))
    rows = rows.select("m", "x", "y", "n", F.pmod(F.xxhash64("m", "x", "y"), F.lit(_BUCKETS)).cast("int").alias("__part"))
    table = materialised(rows)
    width = table.agg(F.max(F.size("x"))).first()[0] or 0
    models = [m for m in names[: len(names) - width] if m != baseline]
    dense = width + int(baseline is not None) + int(intercept)
    order = [*models, *([baseline] if baseline is not None else []), *names[len(names) - width:], *(["intercept"] if intercept else [])]
    place = {m: i for i, m in enumerate(models)}
    weights = {r["__part"]: r["w"] for r in table.groupBy("__part").agg(F.sum("n").alias("w")).collect()}  # _BUCKETS at most
    ids = sorted(weights)
    sizes = np.array([weights[i] for i in ids], np.int64)
    rng = np.random.default_rng(seed)
    per_part = rng.multinomial(sizes.sum(), sizes / max(1, sizes.sum()), size=n_bootstrap) if len(ids) else np.zeros((n_bootstrap, 0))
    shared_plan = spark.sparkContext.broadcast(
        ({i: (weights[i], per_part[:, j].copy()) for j, i in enumerate(ids)}, place)
    )
    fixed = table.repartition("__part").sortWithinPartitions("__part", "y", F.xxhash64("m", "x"), "m", "x").persist()
    n_fits, dim = n_bootstrap + 1, len(models) + dense

    def chunks(batches):
        """Rows of one bucket, cut every _CHUNK rows of it whatever the batches are."""
        held, part = [], None
        for batch in batches:
            own = batch.column("__part").to_numpy()
            edges = np.flatnonzero(np.diff(own)) + 1
            for a, b in zip([0, *edges], [*edges, len(own)]):
                if a == b:
                    continue
                if own[a] != part:
                    yield from _cut(held, part, True)
                    held, part = [], own[a]
                held.append(batch.slice(a, b - a))
                if sum(map(len, held)) >= _CHUNK:
                    yield from _cut(held, part, False)
        yield from _cut(held, part, True)

    def one_pass(beta: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(beta)

        def add_up(batches):
            plan, index = shared_plan.value
            sums = _Sums(n_fits, len(models), dense)
            last, draw, left, weight = None, None, None, 0
            for part, batch in chunks(batches):
                if part != last:
                    last, draw = part, np.random.default_rng([seed, int(part)])
                    weight, left = plan[int(part)]
                    left = left.copy()
                x = np.array(batch.column("x").to_pylist(), float).reshape(len(batch), -1)
                if baseline is not None:
                    x = np.hstack([np.full((len(x), 1), -1.0), x])
                if intercept:
                    x = np.hstack([x, np.ones((len(x), 1))])
                y, n = batch.column("y").to_numpy(), batch.column("n").to_numpy()
                m = np.array([index.get(v, -1) for v in batch.column("m").to_pylist()], np.int64)
                w = n[:, None].astype(float)
                if n_bootstrap:
                    here = _draws(n, left, weight, draw)
                    left, weight = left - here, weight - int(n.sum())
                    share = n / n.sum()
                    w = np.hstack([w, np.stack([draw.multinomial(k, share) for k in here], axis=1)])
                sums.add(m, x, y, w, shared.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n_fits, dtype=np.int32)), pa.array([r.tobytes() for r in sums.total], pa.binary())],
                ["replicate", "sums"],
            )

        def solve(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for r, v in zip(batch.column("replicate").to_pylist(), batch.column("sums").to_pylist()):
                    v = np.frombuffer(v)
                    total[r] = total[r] + v if r in total else v
            if total:
                some = sorted(total)
                sums = _Sums(len(some), len(models), dense)
                sums.total[:] = [total[r] for r in some]
                step = sums.steps(shared.value[some], penalty)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([s.tobytes() for s in step], pa.binary())], ["replicate", "step"]
                )

        sums = fixed.mapInArrow(add_up, "replicate INT, sums BINARY")
        solved = sums.repartition("replicate").mapInArrow(solve, "replicate INT, step BINARY")
        out = np.zeros((n_fits, dim))
        for r in solved.collect():  # replicates x coefficients, the size of the result
            out[r["replicate"]] = np.frombuffer(r["step"])
        shared.destroy()
        return out

    penalty = np.full(dim, l2)
    if intercept:
        penalty[-1] = 0.0
    beta = np.zeros((n_fits, dim))
    converged = np.zeros(n_fits, bool)
    for _ in range(max_steps):
        step = one_pass(beta)
        beta = beta - np.clip(step, -4, 4)  # damped far from the optimum
        converged = np.abs(step).max(axis=1, initial=0) < _TOLERANCE
        if converged.all():
            break
    fixed.unpersist()
    if baseline is not None and not l2:  # a common shift of all strengths changes nothing
        beta[:, : len(models) + 1] -= beta[:, : len(models) + 1].mean(axis=1, keepdims=True)
    out = pd.DataFrame(beta, columns=order)[[*names, *(["intercept"] if intercept else [])]]
    out.insert(0, "replicate", np.arange(n_fits, dtype=np.int32))
    out.insert(1, "converged", converged)
    return out.melt(["replicate", "converged"], var_name="name", value_name="coef")[
        ["replicate", "name", "coef", "converged"]
    ]


def _cut(held: list, part, whole: bool):
    """Whole chunks out of the rows of one bucket; what is left stays in ``held``."""
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    at = 0
    while len(table) - at >= _CHUNK or whole and at < len(table):
        yield part, table.slice(at, _CHUNK).combine_chunks()
        at += _CHUNK
    held[:] = table.slice(at).to_batches() if at < len(table) else []


def style_fits(
    battles: DataFrame, features: list[str], baseline: str, *, n_bootstrap: int = 100, seed: int = 0
) -> DataFrame:
    """Coefficients of models and style columns per replicate (0: the data itself)."""
    rows, names = design(battles, features, baseline)
    fits = logistic_bootstrap(rows, names, baseline=baseline, n_bootstrap=n_bootstrap, seed=seed)
    return battles.sparkSession.createDataFrame(
        fits, "replicate INT, name STRING, coef DOUBLE, converged BOOLEAN"
    )


def style_leaderboard(fits: DataFrame, features: list[str], baseline: str) -> DataFrame:
    """Win probability against the baseline with the style columns controlled.

    One row per model with the median and the 5 % / 95 % quantiles over the
    replicates, and whether all of them converged.
    """
    drawn = fits.filter("replicate > 0")
    models = drawn.filter(~F.col("name").isin(*features)) if features else drawn
    base = models.filter(F.col("name") == baseline).select("replicate", F.col("coef").alias("base"))
    prob = models.join(base, "replicate").select(
        F.col("name").alias("model"), win_probability(F.col("coef"), F.col("base")).alias("p"), "converged"
    )
    return prob.groupBy("model").agg(
        F.percentile("p", F.lit(0.5)).alias("score"),
        F.percentile("p", F.lit(0.05)).alias("lower"),
        F.percentile("p", F.lit(0.95)).alias("upper"),
        F.bool_and("converged").alias("converged"),
    )


def style_gradient(
    battles: DataFrame, fits: DataFrame, features: list[str], baseline: str, *, outcome: str = "scores"
) -> DataFrame:
    """(name, gradient): slope of the mean loss at the fit on the data itself."""
    fit = {r["name"]: r["coef"] for r in fits.filter("replicate = 0").collect()}  # one per column
    strengths = F.create_map(*[F.lit(x) for n, c in fit.items() if n not in features for x in (n, c)])
    own = F.when(F.col("model") == baseline, F.lit(0.0)).otherwise(strengths[F.col("model")])
    z = own - F.lit(fit[baseline])
    for f in features:
        z = z + F.col(f) * F.lit(fit[f])
    gap = 1 / (1 + F.exp(-z)) - F.col(outcome)
    x = design_columns(sorted(n for n in fit if n not in features), baseline)
    names = [*sorted(n for n in fit if n not in features), *features]
    slopes = battles.select(gap.alias("__gap"), *x, *features).agg(*[
        F.avg(F.col("__gap") * F.col(c)).alias(n) for c, n in zip([f"x_{i}" for i in range(len(x))] + features, names)
    ])
    return slopes.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("gradient")) for n in names])).alias("g")).select("g.*")


def tie_gradient(cells: DataFrame, fits: DataFrame, strata: list[str] = ()) -> DataFrame:
    """(strata, model, gradient): slope of the mean loss in each strength at replicate 0."""
    keys = [*strata, "model"]
    rows = cells.join(fits.filter("replicate = 0").select(*keys, "coef", "eta"), keys)
    tie, sign = F.col("scores") == 0.5, F.when(F.col("scores") == 0, -1.0).otherwise(1.0)
    zz = sign * F.col("coef")
    win, lose = 1 / (1 + F.exp(F.col("eta") - zz)), 1 / (1 + F.exp(zz + F.col("eta")))
    p = F.when(tie, 1 - win - lose).otherwise(win) + 1e-10
    slope = F.when(tie, lose * (1 - lose) - win * (1 - win)).otherwise(win * (1 - win)) * sign
    total = cells.groupBy(*strata).agg(F.sum("n").alias("__all"))
    sums = rows.groupBy(*keys).agg(F.sum(F.col("n") * -slope / p).alias("__s"))
    joined = sums.join(total, list(strata)) if strata else sums.join(total)
    return joined.select(*keys, (F.col("__s") / F.col("__all")).alias("gradient"))


def metadata_counts(metadata: Column, keys: list[str]) -> list[Column]:
    """Numbers out of a metadata map whose values are integers or maps of counts."""
    def total(text):
        inner = F.from_json(text, "map<string,double>")
        return F.coalesce(
            text.try_cast("double"), F.aggregate(F.map_values(inner), F.lit(0.0), lambda a, x: a + x)
        )

    return [total(metadata[k]).alias(k) for k in keys]

