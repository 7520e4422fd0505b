"""Poisson pseudo-maximum likelihood with fixed effects, sandwich errors, Wald tests, event studies.

All rows stay in Spark. Each step of the estimator is a group sum for each fixed effect or one aggregate
of k x k numbers; only coefficients and matrices of that size reach the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- formulas


def parse(formula: str) -> tuple[str, list[str], list[str]]:
    """'y ~ a + a:C(b) | f + g^h' -> (y, terms, fixed effects)."""
    y, _, rest = formula.partition("~")
    right, _, fe = rest.partition("|")
    split = lambda x: [t.strip() for t in x.split("+") if t.strip()]
    return y.strip(), split(right), split(fe)


def design(df: DataFrame, terms: list[str], omit: dict | None = None) -> tuple[DataFrame, list[str]]:
    """df with a column x0, x1, .. for each regressor, and their names.

    a:b multiplies; C(b) makes a dummy for each level. A lone C(b), or a:C(b) beside a itself, leaves out the
    first level (or that of ``omit``); a:C(b) alone has all."""
    omit, out, names = omit or {}, df, []
    for term in terms:
        parts = term.split(":")
        numeric = [p for p in parts if not p.startswith("C(")]
        factors = [re.fullmatch(r"C\((\w+)\)", p)[1] for p in parts if p.startswith("C(")]
        base = F.lit(1.0)
        for p in numeric:
            base = base * F.col(p).cast("double")
        if not factors:
            names.append(term)
            out = out.withColumn(f"x{len(names) - 1}", base)
            continue
        levels = sorted(r[0] for r in df.select(factors[0]).distinct().collect() if r[0] is not None)  # levels of a factor
        skip = omit.get(factors[0], levels[0]) if not numeric or ":".join(numeric) in terms or factors[0] in omit else None
        for v in levels:
            if v != skip:
                mark = "T." if skip is not None else ""
                names.append(":".join([*numeric, f"{factors[0]}[{mark}{v}]"]))
                out = out.withColumn(f"x{len(names) - 1}", base * F.coalesce(F.col(factors[0]) == F.lit(v), F.lit(False)).cast("double"))
    return out, names


# ---------------------------------------------------------------- distributions


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_p(x: float, k: int) -> float:
    """The upper tail, by the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, h = k / 2, x / 2
    front = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= h / n
            total += term
        return max(0.0, 1 - total * front)
    b = h + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


# ---------------------------------------------------------------- the estimator


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    dropped: list[str] = field(default_factory=list)
    deviance: float = 0.0

    def tidy(self) -> list[tuple[str, float, float, float]]:
        """(coefficient, estimate, standard error, p)."""
        se = np.sqrt(np.maximum(np.diag(self.cov), 0))
        return [(n, float(b), float(s), normal_p(b / s) if s else 1.0) for n, b, s in zip(self.names, self.beta, se, strict=True)]

    def __getitem__(self, name: str) -> tuple[float, float]:
        i = self.names.index(name)
        return float(self.beta[i]), float(math.sqrt(max(self.cov[i, i], 0)))

    def wald(self, r: np.ndarray, q: np.ndarray | None = None) -> tuple[float, int, float]:
        """(chi2, degrees of freedom, p) of R beta = q."""
        r = np.atleast_2d(np.asarray(r, float))
        d = r @ self.beta - (0 if q is None else q)
        v = r @ self.cov @ r.T
        k = int(np.linalg.matrix_rank(v))
        x = float(d @ np.linalg.pinv(v) @ d)
        return x, k, chi2_p(x, k)

    def joint_zero(self, names: list[str]) -> tuple[float, int, float]:
        return self.wald(np.eye(len(self.names))[[self.names.index(n) for n in names]])

    def equal(self, names: list[str]) -> tuple[float, int, float]:
        e = np.eye(len(self.names))
        i = [self.names.index(n) for n in names]
        return self.wald(np.array([e[j] - e[i[0]] for j in i[1:]]))


def _key(effect: str):
    return F.concat_ws("\x01", *[F.col(c.strip()).cast("string") for c in effect.split("^")])


class _Part:
    """The rows of one partition: whole groups of the first effect."""

    def __init__(self, batches: list, k: int, sizes: list[int]):
        import pyarrow as pa

        t = pa.Table.from_batches(batches)
        self.y = t.column("_y").to_numpy()
        self.x = np.column_stack([t.column(f"x{i}").to_numpy() for i in range(k)]) if k else np.zeros((len(self.y), 0))
        self.group = np.unique(t.column("_g").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
        self.codes = [t.column(f"_d{i}").to_numpy() for i in range(len(sizes))]
        self.sizes, self.k = sizes, k
        self.cluster = t.column("_cluster").to_numpy(zero_copy_only=False) if "_cluster" in t.column_names else None

    def linear(self, beta: np.ndarray) -> np.ndarray:
        out, at = self.x @ beta[: self.k], self.k
        for c, n in zip(self.codes, self.sizes, strict=True):
            out = out + np.append(0.0, beta[at : at + n - 1])[c]
            at += n - 1
        return out

    def dense(self) -> np.ndarray:
        out = [self.x]
        for c, n in zip(self.codes, self.sizes, strict=True):
            d = np.zeros((len(c), n))
            d[np.arange(len(c)), c] = 1
            out.append(d[:, 1:])
        return np.hstack(out)

    def means(self, beta: np.ndarray) -> np.ndarray:
        """mu with each group's effect in its closed form: ln(sum y / sum mu without it)."""
        e = np.exp(np.clip(self.linear(beta), -300, 300))
        return e * (np.bincount(self.group, self.y) / np.bincount(self.group, e))[self.group]

    def pieces(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Regressors less their weighted group means, and their weighted square."""
        z = self.dense()
        s = np.bincount(self.group, w)
        centre = np.column_stack([np.bincount(self.group, w * z[:, j]) / s for j in range(z.shape[1])]) if z.shape[1] else np.zeros((len(s), 0))
        z = z - centre[self.group]
        return z, (z * w[:, None]).T @ z


def ppml(df: DataFrame, formula: str, cluster: str | None = None, omit: dict | None = None, rounds: int = 60, tolerance: float = 1e-11) -> Fit:
    """Poisson regression of non-negative y with fixed effects.

    The first effect may have any number of groups: it has a closed form, so it is concentrated out; its rows (a
    panel's destinations and periods) lie in one partition. All other effects enter as dummies, some hundreds.
    Each Newton step is one pass over the rows, whose result is one vector and one matrix for each partition. Groups of
    an effect without any flow are dropped before (their effect is minus infinity), regressors that others
    explain are dropped and named. Errors: clustered with G / (G - 1) * (N - 1) / (N - K), or robust with N / (N - K)."""
    from .. import ship

    spark = df.sparkSession
    ship(spark)
    y, terms, effects = parse(formula)
    effects = effects or ["_one"]
    base = (df.withColumn("_one", F.lit(1)) if effects == ["_one"] else df).withColumn("_y", F.col(y).cast("double"))
    for i, e in enumerate(effects):
        base = base.withColumn(f"_f{i}", _key(e))
        live = base.groupBy(f"_f{i}").agg(F.sum("_y").alias("_s")).where("_s > 0").select(f"_f{i}")
        base = base.join(live, f"_f{i}")
    base, names = design(base, terms, omit)
    k, sizes = len(names), []
    for i in range(1, len(effects)):
        levels = base.select(f"_f{i}").distinct().orderBy(f"_f{i}").collect()  # dummies: as many as columns of the normal matrix
        sizes.append(len(levels))
        table = spark.createDataFrame([(r[0], j) for j, r in enumerate(levels)], f"_f{i} string, _d{i - 1} int")
        base = base.join(F.broadcast(table), f"_f{i}")
    rows = base.select("_y", *[f"x{i}" for i in range(k)], F.col("_f0").alias("_g"), *[f"_d{i}" for i in range(len(sizes))], *([F.col(cluster).cast("string").alias("_cluster")] if cluster else []))
    rows = rows.repartition("_g").persist()
    n = rows.count()
    width = k + sum(s - 1 for s in sizes)

    def over(do) -> list:
        """do(part) gives a tuple of arrays; their sums over all partitions."""

        def run(batches):
            import pyarrow as pa

            held = list(batches)
            if sum(b.num_rows for b in held):
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, float).tobytes()]) for x in do(_Part(held, k, sizes))], names=[f"r{i}" for i in range(3)])

        def added(batches):
            import pyarrow as pa

            total = None
            for b in batches:
                for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    got = [np.frombuffer(x, float) for x in r]
                    total = got if total is None else [u + v for u, v in zip(total, got, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in total], names=[f"r{i}" for i in range(3)])

        # one job: partitions give partials, about the square root as many tasks add them up, the driver adds those
        schema = "r0 binary, r1 binary, r2 binary"
        parts = rows.mapInArrow(run, schema).repartition(max(1, math.isqrt(rows.rdd.getNumPartitions()))).mapInArrow(added, schema).collect()
        return [sum(np.frombuffer(x, float) for x in column) for column in zip(*parts, strict=True)]

    def start(p: _Part):
        z, square = p.pieces(np.ones(len(p.y)))
        return square, (p.dense() ** 2).sum(axis=0), [0.0]

    square, scale, _ = over(start)
    square = square.reshape(width, width)
    # columns in order, dummies of effects first, so that what they explain is dropped from the regressors
    keep: list[int] = []
    for j in [*range(k, width), *range(k)]:
        rest = square[j, j]
        if keep:
            rest -= square[j, keep] @ np.linalg.lstsq(square[np.ix_(keep, keep)], square[keep, j], rcond=None)[0]
        if rest > 1e-10 * max(scale[j], 1e-300):
            keep.append(j)
    keep.sort()
    dropped = [names[j] for j in range(k) if j not in keep]

    def step(at: np.ndarray):
        def do(p: _Part):
            mu = p.means(at)
            z, h = p.pieces(mu)
            loss = np.where(p.y > 0, p.y * np.log(np.maximum(p.y, 1e-300) / mu), 0) - (p.y - mu)
            return z.T @ (p.y - mu), h, [2 * loss.sum()]

        return over(do)

    beta, move, last = np.zeros(width), np.zeros(width), math.inf
    for _ in range(rounds):
        g, h, (deviance,) = step(beta)
        if deviance > last * (1 + 1e-12) + 1e-12 and np.abs(move).max() > 1e-12:  # a step too far is halved
            move = move / 2
            beta = beta - move
            continue
        h = h.reshape(width, width)
        done = abs(last - deviance) <= tolerance * (abs(deviance) + 0.1)
        last = deviance
        if done:
            break
        move = np.zeros(width)
        move[keep] = np.linalg.lstsq(h[np.ix_(keep, keep)], g[keep], rcond=None)[0]
        beta = beta + move
    bread = np.linalg.pinv(h[np.ix_(keep, keep)])
    final = beta

    def scores(p: _Part):
        mu = p.means(final)
        return p, (p.pieces(mu)[0] * (p.y - mu)[:, None])[:, keep]

    if cluster:

        def by_cluster(batches):
            import pyarrow as pa

            held = list(batches)
            if sum(b.num_rows for b in held):
                p, s = scores(_Part(held, k, sizes))
                label, g = np.unique(p.cluster.astype(str), return_inverse=True)
                sums = np.column_stack([np.bincount(g, s[:, j]) for j in range(s.shape[1])]) if s.shape[1] else np.zeros((len(label), 0))
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["c", "v"])

        def square_of(batches):
            import pyarrow as pa

            m, groups = np.zeros((len(keep), len(keep))), 0
            for b in batches:
                v = np.array(b.column(1).to_pylist()).reshape(-1, len(keep))
                m, groups = m + v.T @ v, groups + len(v)
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()]), pa.array([groups])], names=["m", "n"])

        part = rows.mapInArrow(by_cluster, "c string, v array<double>")
        whole = part.select("c", F.posexplode("v").alias("j", "v")).groupBy("c", "j").agg(F.sum("v").alias("v")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda q: q["v"]).alias("v"))
        meat, groups = np.zeros((len(keep), len(keep))), 0
        for r in whole.repartition(16).mapInArrow(square_of, "m binary, n long").collect():  # a matrix for each of a few tasks
            meat, groups = meat + np.frombuffer(r[0], float).reshape(meat.shape), groups + r[1]
        factor = groups / max(1, groups - 1) * (n - 1) / max(1, n - len(keep))
    else:

        def meats(p: _Part):
            s = scores(p)[1]
            return s.T @ s, [0.0], [0.0]

        meat = over(meats)[0].reshape(len(keep), len(keep))
        factor = n / max(1, n - len(keep))
    rows.unpersist()
    cov = factor * bread @ meat @ bread
    mine = [i for i, j in enumerate(keep) if j < k]
    return Fit([names[keep[i]] for i in mine], beta[[keep[i] for i in mine]], cov[np.ix_(mine, mine)], n, dropped, float(last))


def event_study(df: DataFrame, y: str, treated: str, period: str, omitted: int, effects: str, cluster: str | None = None, controls: tuple = ()) -> tuple[Fit, list[tuple[int, float, float]]]:
    """The fit, and (period, effect, standard error) of treatment in each period; the omitted one is exactly 0."""
    marked = df.withColumn("_d", F.col(treated).cast("double"))
    f = ppml(marked, f"{y} ~ {' + '.join([*controls, f'_d:C({period})'])} | {effects}", cluster, {period: omitted})
    path = {omitted: (0.0, 0.0)}
    for name in f.names:
        if m := re.fullmatch(rf"_d:{period}\[T\.(-?\d+)\]", name):
            path[int(m[1])] = f[name]
    return f, [(k, *path[k]) for k in sorted(path)]


def near_and_far(df: DataFrame, y: str, treated: str, post: str, km: str, at: float, effects: str, cluster: str | None = None) -> Fit:
    """Both effects of treatment after the event in one regression: of origins nearer than ``at`` and of the others."""
    both = df.withColumns({
        "near_effect": (F.col(treated).cast("double") * F.col(post).cast("double") * (F.col(km) < at).cast("double")),
        "far_effect": (F.col(treated).cast("double") * F.col(post).cast("double") * (F.col(km) >= at).cast("double")),
    })
    return ppml(both, f"{y} ~ near_effect + far_effect | {effects}", cluster)


def placebos(df: DataFrame, y: str, dest: str, post: str, effects: str, names: list[str], cluster: str | None = None) -> list[tuple[str, float, float]]:
    """(destination, effect, standard error): each destination in turn as if treated."""
    out = []
    for name in names:
        f = ppml(df.withColumn("_p", ((F.col(dest) == name) & F.col(post).cast("boolean")).cast("double")), f"{y} ~ _p | {effects}", cluster)
        out.append((name, *(f["_p"] if "_p" in f.names else (math.nan, math.nan))))
    return out


def series(base: float, base_se: float, steps: dict, z: float = 1.96) -> list[tuple]:
    """(period, base + step, low, high), with the errors added up: a conservative interval."""
    return [(k, base + b, base + b - z * (base_se + s), base + b + z * (base_se + s)) for k, (b, s) in sorted(steps.items())]


def robustness(df: DataFrame, checks: list[tuple], cluster: str | None = None) -> list[tuple]:
    """(check, term, estimate, standard error, p, rows) of each (check, condition on rows or None, formula), in order."""
    out = []
    for name, where, formula in checks:
        f = ppml(df if where is None else df.where(where), formula, cluster)
        out += [(name, *row, f.n) for row in f.tidy()]
    return out
