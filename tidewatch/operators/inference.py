"""Inference without a row a replicate and without holding a key's rows: null windows by prefix sums, logistic fits by grouped sums, survival."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.stats import chi2_sf, t_sf
from tidewatch.functions.windows import ordered, so_far

from .evaluate import CELL, cohens_d, event_bounds
from .joins import lower_bound

KEYS = ("series_id", "method")


def drawn(*parts: Column | str) -> Column:
    """A reproducible number below 2**32 from the text of its parts: the first eight hex digits of their md5 (see drawn_sql)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def drawn_sql(*parts: str) -> str:
    return "('0x' || md5(concat_ws('|', " + ", ".join(parts) + "))[1:8])::BIGINT"


def prefix_sums(scores: DataFrame) -> DataFrame:
    """series_id, method, at, n, s, q: number, sum and sum of squares of the scores in the first `at` rows (t from 0), less `base`, the series' first score."""
    w = so_far(ordered(*KEYS))
    base = F.first("score", ignorenulls=True).over(Window.partitionBy(*KEYS).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = scores.select(*KEYS, "t", "score").withColumn("base", base).withColumn("_x", F.col("score") - F.col("base"))
    return x.select(*KEYS, (F.col("t") + 1).alias("at"), F.count("_x").over(w).alias("n"), F.coalesce(F.sum("_x").over(w), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("_x") * F.col("_x")).over(w), F.lit(0.0)).alias("q"), "base")


def window_moments(sums: DataFrame, windows: DataFrame, ids: list[str]) -> DataFrame:
    """series_id, method, ids, n1, m1, v1, n2, m2, v2: moments of the scores inside and outside windows.

    windows: series_id, ids and the row numbers [a, b) of a window, several rows of equal ids being
    parts of one. Each end is one look-up in the sums; no row is met.
    """
    last = sums.groupBy(*KEYS).agg(F.max_by(F.struct("n", "s", "q", "base"), "at").alias("all"))
    ends = windows.select("series_id", *ids, F.explode(F.array(F.struct(F.col("b").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("a").alias("at"), F.lit(-1).alias("sign")))).alias("_e")).select("series_id", *ids, "_e.*")
    hits = ends.where("at > 0").join(sums, ["series_id", "at"])
    g = hits.groupBy(*KEYS, *ids).agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in "nsq"]).join(last, list(KEYS))
    n2, s2, q2 = (F.col(f"all.{c}") - F.col(c) for c in "nsq")
    var = lambda n, s, q: F.when(n > 1, F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))
    n, s, q = (F.col(c) for c in "nsq")
    mean = lambda n, s: F.when(n > 0, s / n + F.col("all.base"))
    return g.select(*KEYS, *ids, n.alias("n1"), mean(n, s).alias("m1"), var(n, s, q).alias("v1"), n2.alias("n2"), mean(n2, s2).alias("m2"), var(n2, s2, q2).alias("v2"))


def event_windows(scores: DataFrame, events: DataFrame) -> DataFrame:
    """series_id, event_id, a, b: the rows [a, b) of each event in each series."""
    rows = scores.select("series_id", "ts", "t").distinct().withColumn("method", F.lit(""))
    return event_bounds(rows, events).select("series_id", "event_id", F.col("t_start").alias("a"), (F.col("t_stop") + 1).alias("b"))


def disjoint_windows(windows: DataFrame, rows: DataFrame, replicates: int, seed: int = 5) -> DataFrame:
    """series_id, rep, event_id, a, b: each series' windows put at random places where none overlap, `replicates` times.

    The windows stand in a drawn order, and the free rows between them are cut at drawn places, sorted:
    every placement in that order is as likely as any other. rows: series_id, n. A series whose
    windows fill more rows than it has gets none.
    """
    all_ = Window.partitionBy("series_id")
    w = windows.withColumn("len", F.col("b") - F.col("a")).withColumn("_total", F.sum("len").over(all_)).join(rows, "series_id").where("_total <= n")
    w = w.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_cut", F.pmod(drawn(F.lit(seed), "rep", "series_id", "event_id", F.lit("cut")), F.col("n") - F.col("_total") + 1))
    one = Window.partitionBy("series_id", "rep")
    turn = one.orderBy(drawn(F.lit(seed), "rep", "series_id", "event_id", F.lit("turn")), "event_id")
    w = w.withColumn("_k", F.row_number().over(turn)).withColumn("_before", F.sum("len").over(turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"))
    w = w.withColumn("_cuts", F.array_sort(F.collect_list("_cut").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    a = F.element_at("_cuts", F.col("_k")) + F.col("_before")
    return w.select("series_id", "rep", "event_id", a.alias("a"), (a + F.col("len")).alias("b"))


def shifted_windows(windows: DataFrame, rows: DataFrame, replicates: int, seed: int = 3) -> DataFrame:
    """series_id, rep, event_id, a, b: what each window covers when the scores are turned by a drawn number of rows, at least the longest window; one or two parts."""
    longest = F.max(F.col("b") - F.col("a")).over(Window.partitionBy("series_id"))
    w = windows.withColumn("_least", longest).join(rows, "series_id").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    off = F.col("_least") + F.pmod(drawn(F.lit(seed), "rep", "series_id"), F.greatest(F.col("n") - F.col("_least"), F.lit(1)))
    w = w.withColumn("_a", F.pmod(F.col("a") + off, F.col("n"))).withColumn("_b", F.col("_a") + F.col("b") - F.col("a"))
    parts = F.filter(F.array(F.struct(F.col("_a").alias("a"), F.least("_b", "n").alias("b")), F.struct(F.lit(0).cast("long").alias("a"), (F.col("_b") - F.col("n")).alias("b"))), lambda p: p["b"] > p["a"])
    return w.select("series_id", "rep", "event_id", F.explode(parts).alias("_p")).select("series_id", "rep", "event_id", "_p.*")


def null_windows(scores: DataFrame, events: DataFrame, replicates: int = 200, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """series_id, method, kind, real_median, null_median, q025, q975, p: the median effect over event windows against two nulls.

    random_windows puts windows of equal lengths at disjoint random places; circular_shift turns the
    scores under the windows. p is the share of replicates with at least the real median. Windows
    with fewer than two scores on a side count as effect 0. `keep` writes a table and reads it back.
    """
    sums = keep(prefix_sums(scores))
    windows = keep(event_windows(scores, events))
    rows = scores.groupBy("series_id").agg((F.max("t") + 1).alias("n"))
    effect = lambda w, ids: cohens_d(window_moments(sums, w, ids)).withColumn("d", F.coalesce("d", F.lit(0.0)))
    real = effect(windows, ["event_id"]).groupBy(*KEYS).agg(F.percentile("d", F.lit(0.5)).alias("real_median"))
    made = [w.withColumn("kind", F.lit(kind)) for kind, w in (("random_windows", disjoint_windows(windows, rows, replicates)), ("circular_shift", shifted_windows(windows, rows, replicates)))]
    null = effect(made[0].unionByName(made[1]), ["kind", "rep", "event_id"]).groupBy(*KEYS, "kind", "rep").agg(F.round(F.percentile("d", F.lit(0.5)), 9).alias("d"))
    j = null.join(real, list(KEYS)).groupBy(*KEYS, "kind")
    q = lambda x: F.percentile("d", F.lit(x))
    return j.agg(F.max("real_median").alias("real_median"), q(0.5).alias("null_median"), q(0.025).alias("q025"), q(0.975).alias("q975"), F.avg((F.col("d") >= F.round("real_median", 9)).cast("double")).alias("p"))


def circular_shift_null(scores: DataFrame, events: DataFrame, shifts: int = 200, seed: int = 3) -> DataFrame:
    """CELL, d, p of each cell's d under circular shifts of the scores: (1 + shifts with as large a d) / (1 + shifts)."""
    sums, windows = prefix_sums(scores), event_windows(scores, events)
    rows = scores.groupBy("series_id").agg((F.max("t") + 1).alias("n"))
    seen = cohens_d(window_moments(sums, windows, ["event_id"])).where("n1 > 0").select(*CELL, F.round("d", 9).alias("d"))
    null = cohens_d(window_moments(sums, shifted_windows(windows, rows, shifts, seed), ["rep", "event_id"])).select(*CELL, F.round("d", 9).alias("_d"))
    return seen.join(null, list(CELL)).groupBy(*CELL).agg(F.max("d").alias("d"), ((F.sum(F.coalesce((F.col("_d") >= F.col("d")).cast("int"), F.lit(0))) + 1) / (shifts + 1)).alias("p"))


# logistic models of every key at once


def logistic_models(df: DataFrame, models: dict[str, list[str]], label: str, keys: list[str], keep: Callable[[DataFrame], DataFrame], c: float = 1.0, rounds: int = 25) -> DataFrame:
    """keys, model, weights (of all columns, then the intercept; 0 for columns that a model lacks), n, positives, nll.

    L2 logistic regression (c times the log-loss, intercept free) of each model's columns for every key
    together: a Newton step is one grouped aggregation of gradient and curvature sums, followed by
    the keys' small systems, solved in batches. Rows with a null are left out, keys with one class too.
    """
    cols = sorted({x for used in models.values() for x in used})
    d = len(cols) + 1
    rows = df.select(*keys, F.col(label).cast("double").alias("_y"), *cols).dropna()
    masks = F.array(*[F.struct(F.lit(m).alias("model"), *[F.lit(float(x in used)).alias(f"_m{i}") for i, x in enumerate(cols)]) for m, used in models.items()])
    rows = rows.withColumn("_k", F.explode(masks))
    rows = rows.select(*keys, "_k.model", "_y", *[(F.col(x) * F.col(f"_k._m{i}")).cast("double").alias(f"_x{i}") for i, x in enumerate(cols)]).withColumn(f"_x{d - 1}", F.lit(1.0))
    by = [*keys, "model"]
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("positives")).where("positives > 0 and positives < n")
    rows = keep(rows)
    fit = keep(whole.withColumn("weights", F.array_repeat(F.lit(0.0), d)))
    z = lambda w: sum((F.col(f"_x{i}") * F.element_at(w, i + 1) for i in range(d)), F.lit(0.0))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def solve(batches):
        for batch in batches:
            m = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n[:2] in ("_g", "_h")}
            h = np.zeros((batch.num_rows, d, d))
            for i, j in pairs:
                h[:, i, j] = h[:, j, i] = c * m[f"_h{i}_{j}"]
            w = np.array(batch.column("weights").to_pylist()).reshape(-1, d)
            ridge = np.append(np.ones(d - 1), 0.0)
            g = c * np.stack([m[f"_g{i}"] for i in range(d)], 1) + ridge * w
            step = np.linalg.solve(h + np.diag(ridge + 1e-12), g[:, :, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (*by, "n", "positives")], pa.array((w - step).tolist(), pa.list_(pa.float64())), pa.array(np.abs(step).max(1))], names=[*by, "n", "positives", "weights", "_step"])

    kinds = dict(fit.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in (*by, "n", "positives")) + ", weights array<double>, _step double"
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-z("weights")))
        x = rows.join(fit.select(*by, "weights"), by).withColumn("_p", p)
        sums = [F.sum((F.col("_p") - F.col("_y")) * F.col(f"_x{i}")).alias(f"_g{i}") for i in range(d)]
        sums += [F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_h{i}_{j}") for i, j in pairs]
        stepped = keep(x.groupBy(*by).agg(*sums).join(fit, by).mapInArrow(solve, out))
        fit = stepped.drop("_step")
        if (stepped.agg(F.max("_step")).first()[0] or 0.0) < 1e-10:
            break
    m = z("weights")
    loss = F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))) - F.col("_y") * m
    nll = rows.join(fit.select(*by, "weights"), by).groupBy(*by).agg(F.sum(loss).alias("nll"))
    return fit.join(nll, by)


def likelihood_ratio(df: DataFrame, a: str, b: str, label: str, keys: list[str], keep: Callable[[DataFrame], DataFrame], c: float = 1.0) -> DataFrame:
    """keys, n, nll of both, of a only and of b only, and the ratio statistics and p of what each adds to the other (chi-square, one degree)."""
    fits = keep(logistic_models(df, {"both": [a, b], "a": [a], "b": [b]}, label, keys, keep, c))
    of = lambda m, x: F.max(F.when(F.col("model") == m, F.col(x)))
    names = sorted([a, b])
    w = lambda x: F.element_at(of("both", "weights"), names.index(x) + 1)
    g = fits.groupBy(*keys).agg(F.max("n").alias("n"), of("both", "nll").alias("nll_both"), of("a", "nll").alias("nll_a"), of("b", "nll").alias("nll_b"), w(a).alias("weight_a"), w(b).alias("weight_b"))
    g = g.withColumn("lr_b_given_a", 2 * (F.col("nll_a") - F.col("nll_both"))).withColumn("lr_a_given_b", 2 * (F.col("nll_b") - F.col("nll_both")))
    one = F.lit(1.0)
    return g.withColumn("p_b_given_a", chi2_sf(F.col("lr_b_given_a"), one)).withColumn("p_a_given_b", chi2_sf(F.col("lr_a_given_b"), one))


# survival


def times_to_events(scores: DataFrame, events: DataFrame, lookback: int = 252, first: int = 60, least: int = 30) -> DataFrame:
    """CELL, t, tte, z: the rows before each event's start (lookback at most, none of the series' first ones), how many rows are left, and z of the score against the 60 rows before.

    An event with fewer than `least` such rows is left out; z is null with fewer than ten earlier scores.
    """
    w = ordered(*KEYS).rowsBetween(-60, -1)
    z = (F.col("score") - F.avg("score").over(w)) / (F.stddev_pop("score").over(w) + 1e-8)
    s = scores.withColumn("z", F.when((F.count("score").over(w) >= 10) & F.col("score").isNotNull(), z))
    t0 = lower_bound(scores.select("series_id", "ts", "t").distinct(), events).withColumn("_back", F.least(F.lit(lookback), F.col("t0") - first)).where(F.col("_back") >= least)
    spots = t0.select("series_id", "event_id", "t0", F.explode(F.sequence(F.col("t0") - F.col("_back"), F.col("t0") - 1)).alias("t"))
    return s.join(spots, ["series_id", "t"]).select(*CELL, "t", (F.col("t0") - F.col("t")).alias("tte"), "z")


def survival_association(times: DataFrame, least: int = 30) -> DataFrame:
    """method, n, beta, p: correlation of z with -log(time to event + 1) over all series and events, a stand-in for the log hazard; the larger, the sooner."""
    x = times.where("z is not null").select("method", "z", (-F.log(F.col("tte") + 1.0)).alias("_h"))
    g = x.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.corr("z", "_h").alias("beta")).where(F.col("n") >= least)
    t = F.abs("beta") * F.sqrt((F.col("n") - 2) / (1 - F.pow("beta", 2)))
    return g.withColumn("p", 2 * t_sf(t, F.col("n") - 2))


def alarm_durations(alarms: DataFrame, starts: DataFrame) -> DataFrame:
    """series_id, method, t, time, observed: rows from each alarm's onset to the next event's start, or to the series' end, censored.

    alarms: series_id, method, t, alarm; starts: series_id, event_id, t0.
    """
    w = ordered(*KEYS)
    on = F.col("alarm") & ~F.coalesce(F.lag("alarm").over(w), F.lit(False))
    x = alarms.select(*KEYS, "t", on.alias("_on"), F.max("t").over(Window.partitionBy(*KEYS)).alias("_end"))
    marks = alarms.select(*KEYS).distinct().join(starts.select("series_id", F.col("t0").alias("t"), F.col("t0").alias("_start")), "series_id")
    both = x.unionByName(marks, allowMissingColumns=True)
    # a start at the onset's own row is no longer ahead of it
    ahead = F.min("_start").over(Window.partitionBy(*KEYS).orderBy("t").rangeBetween(1, Window.unboundedFollowing))
    return both.withColumn("_next", ahead).where("_on").select(*KEYS, "t", (F.coalesce("_next", "_end") - F.col("t")).alias("time"), F.col("_next").isNotNull().alias("observed"))


def kaplan_meier(durations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, time, at_risk, events, survival: the product-limit estimate at each time with an event.

    The number at risk is what has at least that time. durations: keys, time, observed. Times are counted
    first, so the windows run over distinct times only. Null times are left out.
    """
    g = durations.where("time is not null").groupBy(*keys, "time").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("observed").cast("int")).alias("events"))
    later = Window.partitionBy(*keys).orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("at_risk", F.sum("_n").over(later)).where("events > 0")
    left = F.when(F.col("events") < F.col("at_risk"), F.log1p(-F.col("events") / F.col("at_risk")))
    upto = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    none = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(upto)
    return g.withColumn("survival", F.when(none == 1, 0.0).otherwise(F.exp(F.sum(left).over(upto)))).select(*keys, "time", "at_risk", "events", "survival")


# lead times and paired differences: small tables, resampled by drawn numbers


def bootstrap_means(df: DataFrame, x: str, keys: list[str], unit: str, replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """keys, n, mean, ci_lo, ci_hi: percentile interval of the mean over resamples of the keys' values; nulls are left out, keys with under three values too.

    `unit` numbers a key's values. A resample's places are drawn from (seed, replicate, keys, place).
    """
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), (F.row_number().over(w.orderBy(unit)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("n")).where("n >= 3")
    reps = rows.select(*keys, "n", F.col("_i").alias("_slot")).withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    picks = reps.withColumn("_i", F.pmod(drawn(F.lit(seed), "_rep", *keys, "_slot"), F.col("n")).cast("int"))
    means = picks.join(rows.select(*keys, "_i", "_x"), [*keys, "_i"]).groupBy(*keys, "_rep").agg(F.avg("_x").alias("_m"))
    tail = (1 - level) / 2
    ci = means.groupBy(*keys).agg(F.percentile("_m", F.lit(tail)).alias("ci_lo"), F.percentile("_m", F.lit(1 - tail)).alias("ci_hi"))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), F.avg("_x").alias("mean")).join(ci, keys)


def sign_permutation(df: DataFrame, d: str, keys: list[str], unit: str, replicates: int = 1000, seed: int = 17) -> DataFrame:
    """keys, n, mean, p: share of drawn sign changes of paired differences (themselves counted) whose mean is at least as far from 0; nulls are left out."""
    rows = df.where(F.col(d).isNotNull()).select(*keys, F.col(unit).alias("_u"), F.col(d).cast("double").alias("_d"))
    seen = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean"))
    reps = rows.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    flip = F.when(F.pmod(drawn(F.lit(seed), "_rep", *keys, "_u"), F.lit(2)) == 0, 1).otherwise(-1)
    m = reps.groupBy(*keys, "_rep").agg(F.avg(F.col("_d") * flip).alias("_m"))
    far = F.sum((F.round(F.abs("_m"), 9) >= F.round(F.abs("mean"), 9)).cast("int"))
    return m.join(seen, keys).groupBy(*keys).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), ((far + 1) / (replicates + 1)).alias("p"))


def held_out_recalibration(df: DataFrame, p: str, label: str, fold: str, keys: list[str], bins: int = 10) -> DataFrame:
    """keys, fold, n, brier, brier_recalibrated: a fold's predictions replaced by the share of positives that the other folds have in their bin.

    Every (bin, fold) is counted once; what the others have is the total less the fold's own. A bin that no other
    fold has keeps its predictions. Null predictions and labels are left out.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(label).isNotNull()).select(*keys, F.col(fold).alias("fold"), F.col(p).alias("_p"), F.col(label).cast("double").alias("_y"))
    rows = rows.withColumn("_b", F.least(F.floor(F.col("_p") * bins), F.lit(bins - 1)))
    own = rows.groupBy(*keys, "fold", "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s"), F.sum(F.pow(F.col("_p") - F.col("_y"), 2)).alias("_q"), F.sum("_p").alias("_sp"), F.sum(F.col("_p") * F.col("_p")).alias("_sq"))
    every = Window.partitionBy(*keys, "_b")
    n, s = F.sum("_n").over(every) - F.col("_n"), F.sum("_s").over(every) - F.col("_s")
    share = F.when(n > 0, s / n)
    # sum of (share - y)^2 over the fold's rows of the bin, y being 0 or 1
    again = F.when(share.isNotNull(), F.col("_n") * share * share - 2 * share * F.col("_s") + F.col("_s")).otherwise(F.col("_q"))
    out = own.withColumn("_a", again)
    return out.groupBy(*keys, "fold").agg(F.sum("_n").alias("n"), (F.sum("_q") / F.sum("_n")).alias("brier"), (F.sum("_a") / F.sum("_n")).alias("brier_recalibrated"))
