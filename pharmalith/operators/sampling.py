"""Virtual populations: bootstrap, (log-)multivariate-normal and chained-equation sampling of covariates.

Random numbers are hashes of (row, stream, seed), so a result does not depend
on partitions or cluster size.  Fitting is aggregates; drawing is a narrow map
over ``spark.range(n)``, but for donors, which are looked up by ranges.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import number_rows
from ..sources.shared import ship_package, written

Limits = dict[str, tuple[float, float]]
#: Donors that predictive mean matching chooses from, the nearest ones.
NEAREST = 5
#: Rows, about, from which iterations before the last take starting values and donors; the last one's donors are all rows.
SAMPLE = 10_000
#: Donors in a range of fitted values, and rows that look for donors there at once.
RANGE_DONORS, RANGE_ROWS = 100_000, 500_000
#: Steps towards the likelihood's maximum that models of categorical columns take at first; in the imputation each iteration adds one.
STEPS = 12


def hashed(row: Column, stream: int, seed: int) -> Column:
    """A whole number below 2**32 from the row's number, by MD5."""
    text = F.concat_ws("-", row.cast("string"), F.lit(str(stream)), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(row: Column, stream: int, seed: int) -> Column:
    """In (0, 1)."""
    return (hashed(row, stream, seed) + F.lit(0.5)) / F.lit(float(1 << 32))


def normal(row: Column, stream: int, seed: int) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2 * F.ln(uniform(row, 2 * stream, seed))) * F.cos(2 * math.pi * uniform(row, 2 * stream + 1, seed))


def conditional_filter(df: DataFrame, conditional: Limits | None) -> DataFrame:
    """Rows inside all limits, ends included; nulls are outside."""
    for name, limits in (conditional or {}).items():
        df = df.where(F.col(name).between(min(limits), max(limits)))
    return df


def sample_covariates_bootstrap(data: DataFrame, n_subjects: int | None = None, conditional: Limits | None = None, seed: int = 1, order_by: Sequence[str] | None = None) -> DataFrame:
    """Exactly ``n_subjects`` rows drawn with replacement from those inside the limits (as many as those by default).

    ``order_by`` makes the draw independent of how rows are stored.
    """
    pool = number_rows(conditional_filter(data, conditional), list(order_by or data.columns), "_nth")
    size = pool.count()
    if not size:
        raise ValueError("no rows inside the limits")
    draws = data.sparkSession.range(size if n_subjects is None else n_subjects).select(((hashed(F.col("id"), 0, seed) % size) + 1).alias("_draw"))
    return draws.join(pool, F.col("_draw") == F.col("_nth")).select(*data.columns)


def moments(df: DataFrame, names: Sequence[str], log: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances in one aggregate; nulls and, for logs, numbers not above 0 raise."""
    value = {n: (F.when(F.col(n) > 0, F.ln(n)) if log else F.col(n).cast("double")) for n in names}
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    row = df.agg(F.count("*"), *[F.count(value[n]) for n in names], *[F.avg(value[n]) for n in names], *[F.covar_samp(value[a], value[b]) for a, b in pairs]).first()
    p = len(names)
    if row[0] < 2 or any(x != row[0] for x in row[1 : p + 1]):
        raise ValueError("at least two rows without missing (or, for logs, non-positive) values are needed")
    cov = np.zeros((p, p))
    for (a, b), v in zip(pairs, row[2 * p + 1 :]):
        i, j = names.index(a), names.index(b)
        cov[i, j] = cov[j, i] = v
    return np.array(row[p + 1 : 2 * p + 1], dtype=float), cov


def _factor(cov: np.ndarray) -> np.ndarray:
    """Lower triangular factor; a singular matrix has columns of zeros where nothing is left."""
    p = len(cov)
    low = np.zeros((p, p))
    for j in range(p):
        rest = cov[j, j] - low[j, :j] @ low[j, :j]
        if rest > 1e-12 * max(cov[j, j], 1e-300):
            low[j, j] = math.sqrt(rest)
            low[j + 1 :, j] = (cov[j + 1 :, j] - low[j + 1 :, :j] @ low[j, :j]) / low[j, j]
    return low


def sample_covariates_mvtnorm(data: DataFrame, cat_covs: Sequence[str] | None = None, n_subjects: int | None = None, exponential: bool = False, conditional: Limits | None = None, seed: int = 1) -> DataFrame:
    """Draws from the normal (log-normal if ``exponential``) distribution fitted to the rows inside the limits.

    ``cat_covs`` has no effect.  Draws themselves are not held to the limits.
    Integer columns come back as doubles.
    """
    pool, names = conditional_filter(data, conditional), data.columns
    mean, cov = moments(pool, names, exponential)
    low = _factor(cov)
    rows = data.sparkSession.range(pool.count() if n_subjects is None else n_subjects)
    rows = rows.select("id", *[normal(F.col("id"), k, seed).alias(f"_z{k}") for k in range(len(names))])
    out = []
    for i, name in enumerate(names):
        x = F.lit(float(mean[i]))
        for k in range(i + 1):
            x = x + F.lit(float(low[i, k])) * F.col(f"_z{k}")
        out.append((F.exp(x) if exponential else x).alias(name))
    return rows.select(*out)


class _Chain:
    """Columns as numbers, models of a column given all others, and draws from them on arrays of rows.

    A row's numbers are 1, standardised continuous columns, and a 0 or 1 for
    every level but the first of categorical ones.
    """

    def __init__(self, data: DataFrame, cats: Sequence[str], method: str, seed: int):
        self.names, self.cats, self.method, self.seed = list(data.columns), set(cats), method, seed
        numeric = [c for c in self.names if c not in self.cats]
        one = data.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{k}") for k, c in enumerate(self.names)], *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in numeric], *[F.stddev_samp(F.col(c).cast("double")).alias(f"s_{c}") for c in numeric]).first()
        self.n, self.seen = one["n"], {c: one[f"n_{k}"] for k, c in enumerate(self.names)}
        if none := [c for c in self.names if not self.seen[c]]:
            raise ValueError(f"no values to learn from in {none}")
        self.center, self.scale = {c: one[f"m_{c}"] for c in numeric}, {c: one[f"s_{c}"] or 1.0 for c in numeric}
        # levels are few by nature
        self.levels = {c: sorted(r[0] for r in data.select(c).where(F.col(c).isNotNull()).distinct().collect()) for c in self.names if c in self.cats}
        self.at, d = {}, 1
        for c in self.names:
            size = len(self.levels[c]) - 1 if c in self.cats else 1
            self.at[c] = np.arange(d, d + size)
            d += size
        self.width = d
        self.pool: dict[str, np.ndarray] = {}

    def others(self, target: str) -> np.ndarray:
        return np.setdiff1d(np.arange(self.width), self.at[target])

    def numbers(self, values: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones((n, self.width))
        for c in self.names:
            for k, column in enumerate(self.at[c]):
                out[:, column] = values[c] == self.levels[c][k + 1] if c in self.cats else (values[c].astype(float) - self.center[c]) / self.scale[c]
        return out

    def uniform(self, ids: np.ndarray, stream: int) -> np.ndarray:
        """Hash of (row, stream, seed) in (0, 1)."""
        with np.errstate(over="ignore"):
            h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((stream * 0xD1B54A32D192ED03 + self.seed * 0x8CB92BA72F3D8DD7) % (1 << 64))
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            h ^= h >> np.uint64(31)
        return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)

    def unpack(self, pdf) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
        """Values, which of them are missing, and ids of a batch."""
        missing = {c: pdf[c].isna().to_numpy() for c in self.names}
        values = {c: pdf[c].to_numpy(dtype=object) if c in self.cats else pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in self.names}
        return values, missing, pdf["_id"].to_numpy()

    def start(self, values: dict[str, np.ndarray], missing: dict[str, np.ndarray], ids: np.ndarray) -> None:
        """Missing values begin as any of the sample's."""
        for j, c in enumerate(self.names):
            if missing[c].any():
                values[c] = np.where(missing[c], self.pool[c][(self.uniform(ids, j) * len(self.pool[c])).astype(int)], values[c])
                values[c] = values[c] if c in self.cats else values[c].astype(float)

    def step(self, models: dict[str, dict], values: dict[str, np.ndarray], missing: dict[str, np.ndarray], ids: np.ndarray, it: int) -> None:
        """One iteration: each missing value is drawn in turn, given all others."""
        for j, c in enumerate(self.names):
            if c in models and missing[c].any():
                drawn = self.draw(c, models[c], values, ids, it * 1000 + j)
                values[c] = np.where(missing[c], drawn, values[c]) if c in self.cats else np.where(missing[c], drawn, values[c]).astype(float)

    def draw(self, target: str, model: dict, values: dict[str, np.ndarray], ids: np.ndarray, stream: int) -> np.ndarray:
        x, u = self.numbers(values, len(ids))[:, self.others(target)], self.uniform(ids, stream)
        if target in self.cats:
            p = _softmax(x @ model["w"])
            at = (u[:, None] > np.cumsum(p, axis=1)).sum(axis=1)
            return np.array(self.levels[target], dtype=object)[np.minimum(at, len(self.levels[target]) - 1)]
        guess = x @ model["drawn"]
        if self.method == "norm":
            other = self.uniform(ids, stream + 500_000)
            return self.center[target] + self.scale[target] * (guess + model["sd"] * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * other))
        return nearest_donor(guess, u, *model["donors"])

    def state(self, target: str, x: np.ndarray, weights: np.ndarray | None) -> dict:
        """Sums over rows where ``target`` is observed that its model is fitted from."""
        out = {"m": x.T @ x}
        if weights is not None:
            levels = np.concatenate([1 - x[:, self.at[target]].sum(axis=1, keepdims=True), x[:, self.at[target]]], axis=1)
            z = x[:, self.others(target)]
            out["g"] = z.T @ (levels - _softmax(z @ weights))
        return out

    def fit(self, target: str, sums: dict, before: dict | None, rng: np.random.Generator) -> dict:
        """A model from sums over all rows, with parameters drawn anew; a categorical one goes a step on from the one before."""
        m, o, t = sums["m"], self.others(target), self.at[target]
        n = m[0, 0]
        a = m[np.ix_(o, o)] + 1e-5 * np.diag(np.maximum(np.diag(m)[o], 1e-9))
        if target not in self.cats:
            b, yy = m[np.ix_(o, t)][:, 0], m[t[0], t[0]]
            beta = np.linalg.solve(a, b)
            rest = max(yy - 2 * beta @ b + beta @ m[np.ix_(o, o)] @ beta, 1e-12)
            sd = math.sqrt(rest / max(rng.chisquare(max(n - len(o), 1)), 1e-9))
            drawn = beta + sd * np.linalg.cholesky(np.linalg.inv(a) + 1e-14 * np.eye(len(a))) @ rng.standard_normal(len(beta))
            return {"beta": beta, "drawn": drawn, "sd": sd}
        if before is not None and "g" in sums:
            # a step of the likelihood's bounded curvature
            return {"w": before["w"] + 2 * np.linalg.solve(a, sums["g"] - 1e-3 * before["w"])}
        # linear discriminants as a start
        size = np.concatenate([[n - m[0, t].sum()], m[0, t]])
        total = np.stack([m[o, 0] - m[np.ix_(o, t)].sum(axis=1), *m[np.ix_(o, t)].T])
        mean = total[:, 1:] / np.maximum(size, 1)[:, None]
        within = m[np.ix_(o[1:], o[1:])] / n - (mean.T * size) @ mean / n
        w = np.linalg.solve(within + 1e-3 * np.eye(len(within)), mean.T)
        return {"w": np.concatenate([[np.log(np.maximum(size, 0.5) / n) - 0.5 * (mean.T * w).sum(axis=0)], w])}


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def nearest_donor(guess: np.ndarray, u: np.ndarray, fitted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of one of the ``NEAREST`` donors by fitted value (ascending), chosen by ``u``."""
    k = min(NEAREST, len(fitted))
    near = np.clip(np.searchsorted(fitted, guess)[:, None] + np.arange(-k, k)[None, :], 0, len(fitted) - 1)
    gap = np.abs(fitted[near] - guess[:, None])
    gap[:, 1:][near[:, 1:] == near[:, :-1]] = np.inf  # places clipped to the ends count once
    best = np.argsort(gap, axis=1, kind="stable")[:, :k]
    row = np.arange(len(guess))
    return values[near[row, best[row, (u * k).astype(int)]]]


def _sums(rows: DataFrame, chain: _Chain, steps: list[dict], targets: Sequence[str], last: dict[str, dict], it: int) -> tuple[dict[str, dict], dict[str, tuple]]:
    """Per target its sums over all rows, values as they are after ``steps``; and a sample of its observed rows as numbers. A row per task to the driver."""
    rate = min(1.0, SAMPLE / max(chain.n, 1))

    def run(batches):
        sums: dict[str, dict] = {}
        picked = {c: [] for c in targets}
        for pdf in batches:
            values, missing, ids = chain.unpack(pdf)
            chain.start(values, missing, ids)
            for k, models in enumerate(steps):
                chain.step(models, values, missing, ids, k + 1)
            x = chain.numbers(values, len(ids))
            chance = chain.uniform(ids, 900_000 + it)
            for c in targets:
                seen = ~missing[c]
                own = chain.state(c, x[seen], last[c]["w"] if c in chain.cats and c in last else None)
                sums[c] = {k: sums[c][k] + v for k, v in own.items()} if c in sums else own
                if c not in chain.cats:
                    picked[c].append((ids[seen & (chance < rate)], x[seen & (chance < rate)]))
        yield pd.DataFrame({"state": [pickle.dumps((sums, picked))]})

    total: dict[str, dict] = {}
    found: dict[str, list] = {c: [] for c in targets}
    for row in rows.mapInPandas(run, "state binary").collect():
        sums, picked = pickle.loads(row.state)
        for c, own in sums.items():
            total[c] = {k: total[c][k] + v for k, v in own.items()} if c in total else own
            found[c] += picked[c]
    sample = {}
    for c, parts in found.items():
        if parts:
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            sample[c] = x[order]
    return total, sample


def _with_donors(chain: _Chain, target: str, model: dict, sample: np.ndarray) -> dict:
    if target in chain.cats or chain.method == "norm":
        return model
    fitted = sample[:, chain.others(target)] @ model["beta"]
    order = np.argsort(fitted, kind="stable")
    return model | {"donors": (fitted[order], chain.center[target] + chain.scale[target] * sample[order, chain.at[target][0]])}


def _with_pool(rows: DataFrame, chain: _Chain) -> None:
    """Gives the chain a sample of each column's values."""
    rate = min(1.0, SAMPLE / max(chain.n, 1))
    for c in chain.names:
        chance = F.pmod(F.xxhash64(F.lit(chain.seed), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        own = rows.where(F.col(c).isNotNull())
        got = own.where(chance < rate * max(1.0, chain.n / chain.seen[c])).select("_id", c).collect() or own.select("_id", c).limit(1).collect()
        got.sort(key=lambda r: r[0])
        chain.pool[c] = np.array([r[1] for r in got], dtype=object if c in chain.cats else float)


def _donated(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """``_id, value`` for ``asked`` rows (``_id, v, u``): of the nearest of all ``offered`` rows (``v, value``), the one that ``u`` says.

    Both are dealt by ranges of ``v`` with about ``RANGE_DONORS`` donors; each
    range also gets the nearest donors of the ranges beside it.
    """
    ship_package(asked.sparkSession)
    n, many = offered.count(), asked.count()
    parts = max(1, math.ceil(n / RANGE_DONORS))
    cuts = sorted(set(offered.agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], 100 * parts)).first()[0])) if parts > 1 else []
    parts = len(cuts) + 1
    place = (F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda c: c <= F.col("v"))) if cuts else F.lit(0)).alias("part")
    salts = max(1, math.ceil(many / parts / RANGE_ROWS))
    given = offered.select(place, "v", "value")
    if cuts:
        rank = lambda order: F.row_number().over(Window.partitionBy("part").orderBy(order)) <= NEAREST
        low = given.withColumn("near", rank(F.col("v").asc())).where("near").select((F.col("part") - 1).alias("part"), "v", "value")
        high = given.withColumn("near", rank(F.col("v").desc())).where("near").select((F.col("part") + 1).alias("part"), "v", "value")
        given = given.unionAll(low).unionAll(high)
    donors = given.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("part", "salt", F.lit(None).cast("long").alias("_id"), "v", F.lit(None).cast("double").alias("u"), "value")
    rows = asked.select(place, F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("salt"), "_id", "v", "u", F.lit(None).cast("double").alias("value"))

    def run(pdf):
        own = pdf[pdf["_id"].isna()].sort_values(["v", "value"], kind="stable")
        those = pdf[pdf["_id"].notna()]
        if not len(those):
            return pd.DataFrame({"_id": np.zeros(0, np.int64), "value": np.zeros(0)})
        return pd.DataFrame({"_id": those["_id"].to_numpy(np.int64), "value": nearest_donor(those["v"].to_numpy(float), those["u"].to_numpy(float), own["v"].to_numpy(float), own["value"].to_numpy(float))})

    # an id is a string on the way: pandas would make it a double beside nulls
    both = donors.unionByName(rows).withColumn("_id", F.col("_id").cast("string"))
    return both.groupBy("part", "salt").applyInPandas(run, "_id long, value double")


def _finished(rows: DataFrame, offered: DataFrame | None, chain: _Chain, steps: list[dict], schema: T.StructType) -> DataFrame:
    """``rows`` with all iterations done; the last one's donors are all rows of ``offered``, or those of ``rows`` with the value observed."""
    ship_package(rows.sparkSession)
    names, last, it = chain.names, steps[-1], len(steps)
    flags = [f"_m{j}" for j in range(len(names))]
    kinds = {c: schema[c].dataType for c in names}
    plain = T.StructType([T.StructField("_id", T.LongType()), *[T.StructField(c, kinds[c] if c in chain.cats else T.DoubleType()) for c in names], *[T.StructField(f, T.BooleanType()) for f in flags]])

    def begun(batches):
        for pdf in batches:
            values, missing, ids = chain.unpack(pdf)
            chain.start(values, missing, ids)
            for k, models in enumerate(steps[:-1]):
                chain.step(models, values, missing, ids, k + 1)
            yield pd.DataFrame({"_id": ids, **values, **{f: missing[c] for f, c in zip(flags, names)}})

    state = written(rows.select("_id", *names).mapInPandas(begun, plain), "begun")
    for j, c in enumerate(names):
        if c not in last:
            continue
        stream, model, flag = it * 1000 + j, last[c], flags[j]
        if c in chain.cats or chain.method == "norm":

            def drawn(batches, c=c, model=model, stream=stream, flag=flag):
                for pdf in batches:
                    values = {x: pdf[x].to_numpy(dtype=object if x in chain.cats else float) for x in names}
                    pdf[c] = np.where(pdf[flag].to_numpy(bool), chain.draw(c, model, values, pdf["_id"].to_numpy(), stream), values[c])
                    yield pdf

            state = state.mapInPandas(drawn, plain)
            continue

        def valued(batches, c=c, weights=None, stream=stream):
            for pdf in batches:
                values = {x: pdf[x].to_numpy(dtype=object if x in chain.cats else float) for x in names}
                ids = pdf["_id"].to_numpy()
                x = chain.numbers(values, len(ids))[:, chain.others(c)]
                # equal fitted values are told apart at random
                yield pd.DataFrame({"_id": ids, "v": x @ weights + 1e-7 * (chain.uniform(ids, stream + 700_000) - 0.5), "u": chain.uniform(ids, stream), "value": values[c]})

        columns = "_id long, v double, u double, value double"
        state = written(state, "drawn") if getattr(state, "_written_at", None) is None else state
        from_rows = (state.where(~F.col(flag)) if offered is None else offered).select("_id", *names)
        donors = from_rows.mapInPandas(partial(valued, weights=model["beta"]), columns).select("v", "value")
        asked = state.where(F.col(flag)).select("_id", *names).mapInPandas(partial(valued, weights=model["drawn"]), columns).select("_id", "v", "u")
        found = _donated(written(asked.dropDuplicates(["_id"]), "asked"), written(donors, "donors")).select(F.col("_id").alias("_to"), F.col("value").alias("_value"))
        state = written(state.join(found, F.col("_id") == F.col("_to"), "left").withColumn(c, F.when(F.col(flag), F.col("_value")).otherwise(F.col(c))).select(*state.columns), "drawn")
    return state.select(*[F.round(c).cast(kinds[c]).alias(c) if isinstance(kinds[c], T.IntegralType) and c not in chain.cats else F.col(c).cast(kinds[c]).alias(c) for c in names])


def impute_missing(data: DataFrame, cat_covs: Sequence[str] = (), iterations: int = 15, cont_method: str = "pmm", seed: int = 1) -> DataFrame:
    """Nulls filled by chained equations; other values stay.

    Each iteration fits every model again to all rows where its column is
    observed, the other columns as they were filled so far, from sums that one
    pass gathers; draws its parameters anew; and draws the missing values.
    Values of iterations before the last one are drawn, for ``pmm``, from the
    nearest of about ``SAMPLE`` rows, others each time; the last ones from the
    nearest of all rows.  Equal rows are filled alike.  A column without any
    value raises; a table without nulls comes back as it is.
    """
    chain = _Chain(data, cat_covs, cont_method, seed)
    targets = [c for c in chain.names if chain.seen[c] < chain.n]
    if not targets:
        return data
    ship_package(data.sparkSession)
    rows = written(data.withColumn("_id", F.xxhash64(F.lit(seed), *data.columns)), "incomplete")
    _with_pool(rows, chain)
    rng, steps, last = np.random.default_rng(seed), [], {}
    for it in range(1, iterations + 1):
        sums, sample = _sums(rows, chain, steps, targets, last, it)
        last = {c: chain.fit(c, sums[c], last.get(c), rng) for c in targets}
        steps.append({c: _with_donors(chain, c, last[c], sample.get(c)) for c in targets})
    return _finished(rows, None, chain, steps, data.schema)


def sample_covariates_mice(data: DataFrame, cat_covs: Sequence[str] = (), conditional: Limits | None = None, n_subjects: int | None = None, cont_method: str = "pmm", iterations: int = 5, impute_iterations: int = 15, seed: int = 1) -> DataFrame:
    """``n_subjects`` simulated rows (as many as ``data`` has by default) by chained equations.

    Missing values of ``data`` are imputed first.  Conditional columns are
    drawn together from rows inside the limits; the others start from observed
    values and are drawn in turn from models given all others, fitted to all
    rows, with parameters drawn anew for each iteration; ``pmm`` takes the last
    iteration's values from the nearest of all rows.
    """
    n = data.count() if n_subjects is None else n_subjects
    full = written(impute_missing(data, cat_covs, impute_iterations, cont_method, seed).withColumn("_id", F.xxhash64(F.lit(seed), *data.columns)), "imputed")
    chain = _Chain(full.select(*data.columns), cat_covs, cont_method, seed)
    rows = data.sparkSession.range(n).withColumnRenamed("id", "_id")
    given = list(conditional or {})
    if given:
        pool = number_rows(conditional_filter(full, conditional).select(*given), given, "_nth")
        if not (size := pool.count()):
            raise ValueError("no rows inside the limits")
        rows = rows.join(pool, (hashed(F.col("_id"), 1, seed) % size) + 1 == F.col("_nth"))
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in data.schema}
    rows = rows.select("_id", *[F.col(c) if c in given else blank[c] for c in data.columns])
    targets = [c for c in chain.names if c not in given]
    if not targets:
        return rows.select(*data.columns)
    ship_package(data.sparkSession)
    _with_pool(full, chain)
    rng = np.random.default_rng(seed)
    sums, sample = _sums(full, chain, [], targets, {}, 0)
    models = {c: chain.fit(c, sums[c], None, rng) for c in targets}
    if own := [c for c in targets if c in chain.cats]:
        for it in range(STEPS):
            steps, _ = _sums(full, chain, [], own, models, it)
            models |= {c: chain.fit(c, steps[c], models[c], rng) for c in own}
    steps = [{c: _with_donors(chain, c, models[c] if c in chain.cats else chain.fit(c, sums[c], None, rng), sample.get(c)) for c in targets} for _ in range(iterations)]
    return _finished(rows, full, chain, steps, data.schema)


#: Methods by name.
METHODS = {"mvtnorm": sample_covariates_mvtnorm, "mice": sample_covariates_mice, "bootstrap": sample_covariates_bootstrap}


def sample_covariates(data: DataFrame, method: str = "mvtnorm", **options) -> DataFrame:
    """Sample covariates by ``method``: mvtnorm, mice or bootstrap."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}")
    return METHODS[method](data, **options)
