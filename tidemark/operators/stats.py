"""Regressions, curve fits and correlation networks. Spark sums; only matrices of k x k, k being the
number of regressors, are handled outside."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fx
from .panel import draw, small

RIDGE = 1e-9


def gram(df: DataFrame, x: Sequence[str], y: str, part: Sequence[str] = ()) -> DataFrame:
    """Sums of products of [1, x.., y] for each key, in one aggregation; rows with a NULL are left out."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in (*x, y)]]
    rows = df.dropna(subset=[*x, y])
    return rows.groupBy(*part).agg(*[F.sum(terms[i] * terms[j]).alias(f"g_{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))])


def solve(row, k: int) -> dict:
    """Least squares from a row of gram: coefficients, inverse, sse, r2, n."""
    g = np.zeros((k + 2, k + 2))
    for i in range(k + 2):
        for j in range(i, k + 2):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"] or 0.0
    xtx, xty, n = g[:-1, :-1] + RIDGE * np.eye(k + 1), g[:-1, -1], g[0, 0]
    inv = np.linalg.inv(xtx)
    beta = inv @ xty
    sse = max(float(g[-1, -1] - 2 * beta @ xty + beta @ (g[:-1, :-1]) @ beta), 0.0)
    total = float(g[-1, -1] - g[0, -1] ** 2 / n) if n else 0.0
    return {"beta": beta, "inv": inv, "sse": sse, "r2": 1 - sse / total if total > 0 else 0.0, "n": int(n), "sigma2": sse / max(n - k - 1, 1)}


def fits(df: DataFrame, x: Sequence[str], y: str, part: Sequence[str] = (), fixed: str | None = None) -> DataFrame:
    """Least squares of y on x for each key, with an effect of each group of fixed (else one intercept): slopes
    and their errors in the order of x, r2, n. Sums of groups are centred on the group's means and added up, in
    two aggregations without a join; the k x k sums of a key are solved inside a task. A NULL group is a group of
    its own, rows with a NULL in x or y are left out, a key without rows gives no row; r2 is 0 where y is constant."""
    k = len(x)
    g = gram(df, x, y, [*part, *([fixed] if fixed else [])]).where("g_0_0 > 0")
    cells = [(i, j) for i in range(1, k + 2) for j in range(i, k + 2)]
    about = [F.sum(F.col(f"g_{i}_{j}") - F.col(f"g_0_{i}") * F.col(f"g_0_{j}") / F.col("g_0_0")).alias(f"w_{i}_{j}") for i, j in cells]
    total = F.sum(f"g_{k + 1}_{k + 1}") - F.pow(F.sum(f"g_0_{k + 1}"), 2) / F.sum("g_0_0")
    sums = g.groupBy(*part).agg(F.sum("g_0_0").cast("long").alias("n"), F.count("*").alias("effects"), total.alias("total"), *about).where("n > 0")

    def run(it):
        for pdf in it:
            out = []
            for row in pdf.to_dict("records"):
                w = np.zeros((k + 1, k + 1))
                for i, j in cells:
                    w[i - 1, j - 1] = w[j - 1, i - 1] = row[f"w_{i}_{j}"]
                inv = np.linalg.inv(w[:k, :k] + RIDGE * np.eye(k))
                beta = inv @ w[:k, k]
                sse = max(float(w[k, k] - 2 * beta @ w[:k, k] + beta @ w[:k, :k] @ beta), 0.0)
                errors = np.sqrt(np.maximum(np.diag(inv), 0) * sse / max(row["n"] - k - row["effects"], 1))
                out.append([*[row[c] for c in part], beta.tolist(), errors.tolist(), 1 - sse / row["total"] if row["total"] > 0 else 0.0, row["n"]])
            yield pd.DataFrame(out, columns=[*part, "slopes", "errors", "r2", "n"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in sums.dtypes if c in part], "slopes array<double>, errors array<double>, r2 double, n long"])
    return sums.mapInPandas(run, schema)


def ols(df: DataFrame, y: str, x: Sequence[str], cluster: str | None = None, fixed: str | None = None) -> tuple[dict, DataFrame]:
    """Least squares of y on 1, x and fixed effects, with classic or, by cluster, CR1 errors. Returns the
    fit (names, beta, se, r2, n, scores by cluster) and df with fitted and residual. With fixed, every column is
    centred on its group's mean and moved to the mean of all rows, so that no group becomes a column and the
    intercept is the mean effect; rows with a NULL group are left out then. The driver sees k x k sums alone."""
    rows = df.dropna(subset=[y, *x, *([fixed] if fixed else [])])
    names, k, spread = list(x), len(x) + 1, None
    target = y
    if fixed:
        own = rows.groupBy(fixed).agg(F.count("*").alias("own_n"), *[F.avg(c).alias(f"own_{i}") for i, c in enumerate((*x, y))])
        every = own.agg(F.count("*").alias("effects"), *[F.try_divide(F.sum(F.col(f"own_{i}") * F.col("own_n")), F.sum("own_n")).alias(f"all_{i}") for i in range(k)])
        rows = rows.join(own.crossJoin(F.broadcast(every)), fixed)  # every is one row
        rows = rows.select("*", *[(F.col(c) - F.col(f"own_{i}") + F.col(f"all_{i}")).alias(f"in_{i}") for i, c in enumerate((*x, y))])
        names, target = [f"in_{i}" for i in range(k - 1)], f"in_{k - 1}"
        spread = rows.agg((F.var_pop(y) * F.count(y)).alias("total"), F.max("effects").alias("effects")).first()
    fit = solve(gram(rows, names, target).first(), len(names))
    if spread:
        k = len(x) + (spread["effects"] or 1)
        fit["r2"] = 1 - fit["sse"] / spread["total"] if spread["total"] else 0.0
        fit["sigma2"] = fit["sse"] / max(fit["n"] - k, 1)
    guess = F.lit(float(fit["beta"][0]))
    for c, b in zip(names, fit["beta"][1:], strict=True):
        guess = guess + F.col(c) * float(b)
    out = rows.withColumn("residual", F.col(target) - guess).withColumn("fitted", F.col(y) - F.col("residual"))
    cov = fit["inv"] * fit["sigma2"]
    if cluster:
        terms = range(len(x) + 1)
        fit["scores"] = out.groupBy(F.col(cluster).alias("cluster")).agg(*[F.sum(F.col("residual") * (F.col(c) if c else F.lit(1.0))).alias(f"s_{i}") for i, c in enumerate([None, *names])])
        meat = fit["scores"].agg(F.count("*").alias("g"), *[F.sum(F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"m_{i}_{j}") for i in terms for j in terms]).first()
        g, n = meat["g"], fit["n"]
        if g > 1 and n > k:
            cov = fit["inv"] @ np.array([[meat[f"m_{i}_{j}"] for j in terms] for i in terms]) @ fit["inv"] * g / (g - 1) * (n - 1) / (n - k)
    fit["names"], fit["se"] = ["intercept", *x], np.sqrt(np.maximum(np.diag(cov), 0))
    return fit, out.drop(*[f"{a}_{i}" for a in ("own", "all", "in") for i in range(len(x) + 1)], "own_n", "effects") if fixed else out


def effects(rows: DataFrame, fit: dict, y: str, x: Sequence[str], fixed: str) -> DataFrame:
    """The effect of each group of fixed in a fit with it, and its coefficient against the group whose name comes first,
    which has the intercept: mean of y less the slopes times the means of x. A NULL group has none."""
    mean = F.avg(y)
    for c, b in zip(x, fit["beta"][1:], strict=True):
        mean = mean - F.avg(c) * float(b)
    own = rows.dropna(subset=[y, *x, fixed]).groupBy(fixed).agg(mean.alias("effect"), F.count("*").alias("n"))
    first = own.agg(F.min_by("effect", fixed).alias("intercept"), F.min(fixed).alias("first"))  # one row
    return own.crossJoin(F.broadcast(first)).select(fixed, "effect", F.when(F.col(fixed) != F.col("first"), F.col("effect") - F.col("intercept")).alias("coefficient"), "n")


def coefficients(spark, fit: dict) -> DataFrame:
    rows = [(n, float(b), float(s), float(fit["r2"]), fit["n"]) for n, b, s in zip(fit["names"], fit["beta"], fit["se"], strict=True)]
    return spark.createDataFrame(rows, "term string, coefficient double, std_error double, r2 double, n long")


def wild_bootstrap(spark, fit: dict, term: int, resamples: int, seed: int = 1) -> DataFrame:
    """Wild cluster bootstrap of one coefficient: beta + sum of w * (inv * score) over clusters, w being -1
    or 1 drawn for resample and cluster; interval, p = 2 * the lesser share beyond 0. No refit is needed."""
    pull = sum((F.col(f"s_{i}") * float(w) for i, w in enumerate(fit["inv"][term])), F.lit(0.0))
    sign = F.when(draw(F.col("resample"), F.col("cluster"), seed) % 2 == 0, 1.0).otherwise(-1.0)
    signs = fit["scores"].select("cluster", pull.alias("pull"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    draws = signs.groupBy("resample").agg((F.sum(sign * F.col("pull")) + float(fit["beta"][term])).alias("b"))
    share = lambda c: F.avg(c.cast("double"))
    return draws.agg(F.percentile("b", 0.025).alias("ci_low"), F.percentile("b", 0.975).alias("ci_high"), F.least(F.lit(1.0), 2 * F.least(share(F.col("b") >= 0), share(F.col("b") <= 0))).alias("p_value"), F.lit(float(fit["beta"][term])).alias("coefficient"))


def reversion_fit(cars: DataFrame, grid: Sequence[float], least_horizon: int = 60, least_r2: float = 0.8) -> DataFrame:
    """For each event (event_id, horizon, car) the tau of the grid whose curve car_inf + (car_0 - car_inf) *
    exp(-h / tau) has the least error (to 12 decimals), the smallest at ties; curves that start outside +-0.5 or end
    outside +-0.3 are left out, and events without a horizon of least_horizon. qualified: r2 is enough.

    An event is one row with its points, made in the one exchange there is; for given tau the curve is a line in
    exp(-h / tau), so all taus of an event are solved at once from a few sums, and no row of the grid exists."""
    taus = np.asarray(grid, float)
    one = cars.where("car IS NOT NULL").groupBy("event_id").agg(F.max("horizon").alias("far"), F.sort_array(F.collect_list(F.struct(F.col("horizon").cast("double").alias("h"), F.col("car").cast("double").alias("y")))).alias("p"))
    one = one.where(F.col("far") >= least_horizon).select("event_id", F.col("p.h").alias("h"), F.col("p.y").alias("y"))
    schema = T.StructType([one.schema["event_id"], *[T.StructField(n, T.DoubleType()) for n in ("tau", "car_0", "car_inf", "r2")]])

    def best(h: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float] | None:
        z = np.exp(-h[None, :] / taus[:, None])
        mz, my = z.mean(1), y.mean()
        dz, dy = z - mz[:, None], y - my
        sxx, sxy, syy = (dz * dz).sum(1), dz @ dy, float(dy @ dy)
        slope = np.divide(sxy, sxx, out=np.zeros(len(taus)), where=sxx > 0)
        inf = my - slope * mz
        start, sse = inf + slope, np.maximum(syy - slope * sxy, 0)
        fits_ = np.flatnonzero((np.abs(start) <= 0.5) & (np.abs(inf) <= 0.3))
        if not len(fits_):
            return None
        k = fits_[np.lexsort((taus[fits_], np.round(sse[fits_], 12)))[0]]
        return float(taus[k]), float(start[k]), float(inf[k]), 1 - float(sse[k]) / syy if syy > 0 else 0.0

    def run(it):
        for b in it:
            ids, h, y = b.column(0), b.column(1), b.column(2)
            found = [best(h[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(b.num_rows)]
            keep = [i for i, f in enumerate(found) if f is not None]
            columns = zip(*[found[i] for i in keep], strict=True) if keep else ([],) * 4
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), *[pa.array(list(c), pa.float64()) for c in columns]], schema.names)

    return one.mapInArrow(run, schema).withColumn("qualified", F.col("r2") >= least_r2)


def spectral_dimension(matrix: np.ndarray) -> tuple[float, list[float]]:
    """2 ** entropy in bits of the normalized eigenvalues, floored at 0, and these."""
    w = np.maximum(np.linalg.eigvalsh(matrix), 0)
    w = w / w.sum() if w.sum() > 0 else w
    return float(2 ** -sum(x * np.log2(x) for x in w if x > 0)), sorted(map(float, w), reverse=True)


def effective_dimension(features: DataFrame, drivers: Sequence[str], part: str = "ticker") -> DataFrame:
    """Dimension of the drivers' correlation for each key with two rows at least, with a tier; one row of
    guarded correlations for each key goes to numpy, nothing else."""
    k = len(drivers)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    r = features.groupBy(part).agg(F.count("*").alias("n"), *[fx.safe_corr(drivers[i], drivers[j]).alias(f"r_{i}_{j}") for i, j in pairs])

    def run(it):
        for pdf in it:
            out = []
            for row in pdf.itertuples(index=False):
                m = np.eye(k)
                for i, j in pairs:
                    m[i, j] = m[j, i] = getattr(row, f"r_{i}_{j}")
                d, w = spectral_dimension(m)
                out.append((getattr(row, part), row.n, d if row.n > 1 else None, w if row.n > 1 else None))
            yield pd.DataFrame(out, columns=[part, "n", "dimension", "eigenvalues"])

    d = r.mapInPandas(run, f"{part} string, n long, dimension double, eigenvalues array<double>")
    v = F.col("dimension")
    tier = F.when(v.isNull(), "insufficient_data").when(v < 2.75, "low").when(v < 3.3, "moderate").when(v < 4.0, "elevated").otherwise("high")
    return d.select("*", tier.alias("tier"))


def reversion_regimes(fits: DataFrame, dims: DataFrame, angles: DataFrame) -> DataFrame:
    """Band of angle (45, 90), grade by dimension (3, 4) and time to nine tenths, of qualified events with a
    dimension."""
    rows = fits.where("qualified").join(angles.select("event_id", "ticker", "angle").where("angle IS NOT NULL"), "event_id").join(dims.where("dimension IS NOT NULL").select("ticker", "dimension"), "ticker")
    place = F.when(F.col("dimension") < 3, 0).when(F.col("dimension") < 4, 1).otherwise(2)
    pick = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), place)
    band = F.when(F.col("angle") < 45, "aligned").when(F.col("angle") < 90, "mixed").otherwise("opposed")
    grade = F.when(F.col("angle") < 45, pick("A+", "A", "A-")).when(F.col("angle") < 90, pick("B+", "B", "B-")).otherwise(pick("C+", "C", "D"))
    return rows.select("event_id", "ticker", "tau", band.alias("band"), grade.alias("grade"), (2.303 * F.col("tau")).alias("t90"))


def tail_screen(events: DataFrame, dims: DataFrame, threshold: float = -0.2) -> DataFrame:
    """Events (event_id, ticker, drawdown) with a tier, whether they fell to the threshold, and the share of
    their tier that did."""
    rows = events.join(dims.select("ticker", "tier"), "ticker").withColumn("flagged", F.coalesce(F.col("drawdown") <= threshold, F.lit(False)))
    rates = rows.groupBy("tier").agg(F.avg(F.col("flagged").cast("double")).alias("hit_rate"))  # a row for each of the five tiers
    return rows.join(F.broadcast(rates), "tier").orderBy(F.asc_nulls_last("drawdown"), "event_id")


def pair_sums(values: DataFrame, key: str = "symbol", day: str = "d", value: str = "x", block: int = 256, days: int = 1 << 14, above: float | None = None, least: int = 0) -> DataFrame:
    """For each two keys with common days, left before right: n, and over those days the sums sx, sy, sxx, syy, sxy of
    their values (one row for each key and day; rows with a NULL are left out), and their correlation xi (0 without
    variance). With `above` only pairs with xi above it on `least` common days or more.

    Keys are dealt to blocks of about `block`; each two blocks meet once as matrices over the whole calendar, whose
    products have the sums, so a row goes to as many groups as there are blocks and only pairs that pass
    leave one: what is shuffled grows with rows and with results. Two blocks hold 2 * block * days numbers. Only
    where there are more than `days` days, pairs come by ranges of so many days and are added up."""
    rows = values.select(F.col(key).cast("string").alias("key"), F.col(day).alias("day"), F.col(value).cast("double").alias("x")).dropna()
    size = rows.agg(F.count_distinct("key").alias("keys"), F.min(F.unix_date("day")).alias("first"), F.max(F.unix_date("day")).alias("last")).first()
    blocks, first = max(1, -(-size["keys"] // block)), size["first"] or 0
    ranges = 1 + ((size["last"] or 0) - first) // days
    mine, other = F.pmod(F.xxhash64("key"), F.lit(blocks)), F.col("other")
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("key", "day", "x", F.least("mine", other).alias("low"), F.greatest("mine", other).alias("high"), "mine", F.floor((F.unix_date("day") - first) / days).alias("range_no"))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(pdf["key"].to_numpy(str), return_inverse=True)
        when = np.unique(pdf["day"].to_numpy(), return_inverse=True)[1]
        x, seen = np.zeros((len(names), when.max() + 1)), np.zeros((len(names), when.max() + 1))
        x[at, when], seen[at, when] = pdf["x"], 1.0
        side = np.empty(len(names), int)
        side[at] = pdf["mine"]
        n, sx, sxx, sxy = seen @ seen.T, x @ seen.T, (x * x) @ seen.T, x @ x.T
        wanted = np.triu(n > 0, 1)
        if pdf["low"].iat[0] != pdf["high"].iat[0]:
            wanted &= side[:, None] != side[None, :]
        if above is not None and ranges == 1:
            wanted &= n >= least
            spread = np.maximum(n * sxx - sx * sx, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                wanted &= (n * sxy - sx * sx.T >= (above - 1e-9) * np.sqrt(spread * spread.T)) | (spread * spread.T == 0)
        i, j = np.nonzero(wanted)
        return pd.DataFrame({"left": names[i], "right": names[j], "n": n[i, j].astype(np.int64), "sx": sx[i, j], "sy": sx[j, i], "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j]})

    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    out = dealt.groupBy("low", "high", "range_no").applyInPandas(products, "left string, right string, n long, sx double, sy double, sxx double, syy double, sxy double").drop("low", "high", "range_no")
    if ranges > 1:
        out = out.groupBy("left", "right").agg(*[F.sum(c).alias(c) for c in sums])
    n, spread = F.col("n"), lambda a, aa: F.greatest(F.col("n") * F.col(aa) - F.col(a) * F.col(a), F.lit(0.0))
    flat = (spread("sx", "sxx") <= 1e-12 * n * F.col("sxx")) | (spread("sy", "syy") <= 1e-12 * n * F.col("syy"))
    xi = F.when(flat, 0.0).otherwise(fx.clamp(F.try_divide(n * F.col("sxy") - F.col("sx") * F.col("sy"), F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))), -1, 1))
    out = out.withColumn("xi", xi)
    return out if above is None else out.where((F.col("n") >= least) & (F.col("xi") > above))


def comovement_edges(returns: DataFrame, market: DataFrame, threshold: float, least: int = 60) -> DataFrame:
    """Pairs of symbols whose excess returns over the market correlate above the threshold on `least` common
    days or more; a pair without variance correlates 0."""
    x = returns.join(small(market.select("d", F.col("ret").alias("m"))), "d").select("symbol", "d", (F.col("ret") - F.col("m")).alias("x"))
    r = pair_sums(x, above=threshold, least=least)
    return r.select(F.col("left").alias("left_symbol"), F.col("right").alias("right_symbol"), "xi", "n").orderBy(F.desc("xi"))


def forest(rows: DataFrame, x: Sequence[str], y: str, train: Column | None = None, trees: int = 50, depth: int = 4, seed: int = 1) -> DataFrame:
    """rows with the prediction of bagged regression trees; missing features count as 0. With a condition train
    the trees are fitted where it holds, and the rows are those where it does not."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = VectorAssembler(inputCols=list(x), outputCol="vector").transform(rows.fillna(0.0, subset=list(x)).dropna(subset=[y]))
    model = RandomForestRegressor(featuresCol="vector", labelCol=y, predictionCol="predicted", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", maxBins=16, minInstancesPerNode=2, seed=seed).fit(data if train is None else data.where(train))
    return model.transform(data if train is None else data.where(~train)).drop("vector")


def r2_of(y: Column, guess: Column) -> Column:
    """Share of the spread of y that guess explains, as an aggregate; 0 where y is constant."""
    return F.coalesce(1 - F.try_divide(F.sum(F.pow(y - guess, 2)), F.var_pop(y) * F.count(y)), F.lit(0.0))
