"""Event-study evaluation: effect sizes, tests, alarms against event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.stats import chi2_sf, f_sf, normal_sf, range_quantile, t_sf
from tidewatch.functions.windows import FLAT, ordered

from .joins import event_members, union_label

CELL = ("series_id", "method", "event_id")


def group_moments(scores: DataFrame, events: DataFrame, pad: int = 0) -> DataFrame:
    """n1, m1, v1 inside and n2, m2, v2 outside each event, without multiplying rows by events.

    Inside moments come from the membership join; outside ones are the series' totals less those.
    """
    ok = scores.where("score is not null")
    sums = [F.count("score").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("q")]
    total = ok.groupBy("series_id", "method").agg(*sums)
    inside = event_members(ok, events, pad).groupBy(*CELL).agg(*[c.alias(f"i{k}") for k, c in zip("nsq", sums)])
    j = inside.join(total, ["series_id", "method"])
    var = lambda n, s, q: F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
    c = F.col
    n2, s2, q2 = c("n") - c("in"), c("s") - c("is"), c("q") - c("iq")
    return j.select(*CELL, c("in").alias("n1"), (c("is") / c("in")).alias("m1"), var(c("in"), c("is"), c("iq")).alias("v1"), n2.alias("n2"), F.when(n2 > 0, s2 / n2).alias("m2"), var(n2, s2, q2).alias("v2"))


def cohens_d(m: DataFrame) -> DataFrame:
    """d = |m1 - m2| / pooled deviation: 0 when flat, null with fewer than two values on a side."""
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    d = F.when(pooled < FLAT, 0.0).otherwise(F.abs(F.col("m1") - F.col("m2")) / pooled)
    return m.withColumn("d", F.when((F.col("n1") >= 2) & (F.col("n2") >= 2), d))


def welch_t(m: DataFrame) -> DataFrame:
    """t, its degrees of freedom and the two-sided p."""
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    m = m.withColumn("t", (F.col("m1") - F.col("m2")) / F.sqrt(a + b)).withColumn("df", F.pow(a + b, 2) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1)))
    return m.withColumn("p", t_sf(F.abs("t"), F.col("df")) * 2)


def bayes_factor(t: Column, n: Column, r: float = 0.707) -> Column:
    """Approximate Bayes factor of two means from Welch's t and the number of rows."""
    df = n - 2
    k = 1 + n / (r * r)
    return F.greatest(F.sqrt(k) * F.pow(1 + t * t / df, -(df + 1) / 2) / F.pow(1 + t * t / (df * k), -(df + 1) / 2), F.lit(1e-300))


def average_rank(df: DataFrame, x: str, keys: list[str], out: str, descending: bool = False) -> DataFrame:
    """Ranks from 1 with ties at their mean."""
    order = F.col(x).desc() if descending else F.col(x)
    w = Window.partitionBy(*keys).orderBy(order)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return df.withColumn(out, F.rank().over(w) + (ties - 1) / 2.0)


def rank_statistics(scores: DataFrame, events: DataFrame, pad: int = 0) -> DataFrame:
    """Mann-Whitney U of each event's rows against the series' others, Cliff's delta and its label, and U's two-sided normal p (ties corrected).

    Ranks and ties are those of all rows of a series, whatever the event, so rows are ranked once
    and only members meet their events.
    """
    keys = ["series_id", "method"]
    r = average_rank(scores.where("score is not null").select(*keys, "ts", "score"), "score", keys, "_r")
    ties = r.groupBy(*keys, "score").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy(*keys).agg(F.sum(F.pow("k", 3) - F.col("k")).alias("ties"), F.sum("k").alias("n"))
    g = event_members(r, events, pad).groupBy(*CELL).agg(F.sum("_r").alias("rs"), F.count(F.lit(1)).cast("double").alias("n1"))
    g = g.join(ties, keys).withColumn("n2", F.col("n") - F.col("n1")).where("n2 > 0")
    u = F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2
    g = g.withColumn("u", u).withColumn("cliff", 2 * u / (F.col("n1") * F.col("n2")) - 1)
    n = F.col("n")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5) / sd
    return g.withColumn("cliff_label", effect_label(F.col("cliff"))).withColumn("p", F.least(2 * normal_sf(z), F.lit(1.0))).drop("rs", "ties", "n")


def effect_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium").otherwise("large")


def holm(df: DataFrame, p: str, keys: list[str], out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values within keys."""
    w = Window.partitionBy(*keys).orderBy(p)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    df = df.withColumn("_a", F.col(p) * (n - F.row_number().over(w) + 1))
    return df.withColumn(out, F.least(F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_a")


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str], out: str = "p_bh") -> DataFrame:
    """Step-up adjusted p-values within keys."""
    w = Window.partitionBy(*keys).orderBy(p)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    df = df.withColumn("_a", F.col(p) * n / F.row_number().over(w))
    return df.withColumn(out, F.least(F.min("_a").over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))).drop("_a")


def friedman(d: DataFrame, block: str = "event_id", method: str = "method", value: str = "d") -> DataFrame:
    """n, k, chi_sq (ties corrected), Iman-Davenport f_stat, their p; only blocks that hold every method."""
    r = complete_ranks(d, block, method, value)
    ties = r.groupBy(block, value).agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum(F.pow("c", 3) - F.col("c")).alias("ties"))
    per = r.groupBy(method).agg(F.sum("rank").alias("rs"), F.count(F.lit(1)).cast("double").alias("n"))
    a = per.agg(F.sum(F.pow("rs", 2)).alias("ss"), F.max("n").alias("n"), F.count(F.lit(1)).cast("double").alias("k")).crossJoin(ties)  # one row each
    n, k = F.col("n"), F.col("k")
    chi = (12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)) / (1 - F.col("ties") / (n * k * (k * k - 1)))
    a = a.where("n >= 3").withColumn("chi_sq", chi)
    a = a.withColumn("f_stat", (n - 1) * F.col("chi_sq") / (n * (k - 1) - F.col("chi_sq")))
    return a.select("n", "k", "chi_sq", chi2_sf(F.col("chi_sq"), k - 1).alias("chi_p"), "f_stat", f_sf(F.col("f_stat"), k - 1, (k - 1) * (n - 1)).alias("f_p"))


def complete_ranks(d: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """Rank (1 = largest) of methods within the blocks that hold them all."""
    d = d.where(F.col(value).isNotNull())
    n = d.agg(F.countDistinct(method).alias("_all"))  # one row
    full = d.groupBy(block).agg(F.countDistinct(method).alias("_have")).join(F.broadcast(n), F.col("_have") == F.col("_all")).select(block)
    return average_rank(d.join(full, block, "left_semi"), value, [block], "rank", descending=True)


def nemenyi(d: DataFrame, block: str = "event_id", method: str = "method", value: str = "d") -> DataFrame:
    """method_a, method_b, difference of mean ranks, critical difference at 0.05, significant; any number of methods from two on."""
    per = complete_ranks(d, block, method, value).groupBy(method).agg(F.avg("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    k = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).cast("int")  # one row a method
    per = per.withColumn("_k", k).withColumn("cd", range_quantile("_k") * F.sqrt(F.col("_k") * (F.col("_k") + 1) / (6.0 * F.col("n"))))
    b = per.select(F.col(method).alias("method_b"), F.col("r").alias("r2"))
    return per.withColumnRenamed(method, "method_a").join(b, F.col("method_a") < F.col("method_b")).select("method_a", "method_b", F.abs(F.col("r") - F.col("r2")).alias("difference"), "cd", (F.abs(F.col("r") - F.col("r2")) > F.col("cd")).alias("significant"))


def auc_pr(scores: DataFrame, events: DataFrame, pad: int = 0) -> DataFrame:
    """Area under precision over recall, trapezoids over distinct thresholds; a null score counts as the series' median.

    Recall moves at members' scores only, and precision just above one needs the number of all rows
    that score more: thresholds are counted once a series and joined to its members.
    """
    keys = ["series_id", "method"]
    med = scores.groupBy(*keys).agg(F.percentile("score", F.lit(0.5)).alias("_med"), F.count(F.lit(1)).alias("_all")).where("_med is not null")
    x = scores.select(*keys, "ts", "score").join(med, keys).withColumn("score", F.coalesce("score", "_med"))
    down = Window.partitionBy(*keys).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    levels = x.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("k")).withColumn("_k", F.sum("k").over(down))
    hits = event_members(x, events, pad).groupBy(*CELL, "score", "_all").agg(F.count(F.lit(1)).alias("tp"))
    w = Window.partitionBy(*CELL).orderBy(F.col("score").desc())
    g = hits.join(levels, [*keys, "score"]).withColumn("_pos", F.sum("tp").over(Window.partitionBy(*CELL))).where("_pos < _all")
    g = g.withColumn("_tp", F.sum("tp").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    above = F.when(F.col("_k") > F.col("k"), (F.col("_tp") - F.col("tp")) / (F.col("_k") - F.col("k"))).otherwise(1.0)
    return g.groupBy(*CELL).agg(F.sum(F.col("tp") / F.col("_pos") * (F.col("_tp") / F.col("_k") + above) / 2).alias("auc_pr"))


def event_bounds(rows: DataFrame, events: DataFrame, pad: int = 0) -> DataFrame:
    """CELL, t_start, t_stop, pos: the first and last row of each event in a series, and its number of rows."""
    return event_members(rows, events, pad).groupBy(*CELL).agg(F.min("t").alias("t_start"), F.max("t").alias("t_stop"), F.count(F.lit(1)).alias("pos"))


def tolerance_f1(alarms: DataFrame, bounds: DataFrame, tolerance: int = 10) -> DataFrame:
    """precision, recall, f1 per cell: each of the two boundaries takes its closest free alarm within `tolerance` rows, the start first.

    alarms: rows (series_id, method, t); bounds: (CELL, t_start, t_stop). Equal distances go to the
    earlier alarm. Alarms meet the rows around a boundary only.
    """
    keys = ["series_id", "method"]
    n = alarms.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_alarms"))
    around = lambda c: F.sequence(F.col(c) - tolerance, F.col(c) + tolerance)
    spots = bounds.select(*CELL, "t_start", "t_stop", F.explode(F.array_distinct(F.concat(around("t_start"), around("t_stop")))).alias("t"))
    j = alarms.select(*keys, "t").distinct().join(spots, [*keys, "t"])
    best = lambda b: F.min(F.when(F.abs(F.col("t") - F.col(b)) <= tolerance, F.struct(F.abs(F.col("t") - F.col(b)).alias("dist"), F.col("t").alias("t"))))
    j = j.withColumn("_at", best("t_start").over(Window.partitionBy(*CELL))["t"])
    ends = F.when(F.abs(F.col("t") - F.col("t_stop")) <= tolerance, 1)
    g = j.groupBy(*CELL).agg(F.max("_at").isNotNull().cast("int").alias("_one"), F.coalesce(F.max(F.when(F.col("_at").isNull() | (F.col("t") != F.col("_at")), ends)), F.lit(0)).alias("_two"))
    out = bounds.join(n, keys, "left").join(g, list(CELL), "left")
    hits, n_al = F.coalesce(F.col("_one") + F.col("_two"), F.lit(0)), F.coalesce("n_alarms", F.lit(0))
    p, r = F.when(n_al > 0, hits / n_al).otherwise(0.0), hits / 2.0
    return out.select(*CELL, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), hits.alias("n_tp"), (n_al - hits).alias("n_fp"))


def point_metrics(alarms: DataFrame, events: DataFrame, alarm: str = "alarm", pad: int = 0, per_year: int = 252) -> DataFrame:
    """Pointwise precision, recall, f1, detection delay (rows from the window's first) and false alarms a year; counts outside an event are totals less those inside."""
    keys = ["series_id", "method"]
    rows = alarms.select(*keys, "ts", "t", F.col(alarm).alias("_on"))
    total = rows.groupBy(*keys).agg(F.count(F.when(F.col("_on"), 1)).alias("_alarms"), F.count(F.lit(1)).alias("_rows"))
    g = event_members(rows, events, pad).groupBy(*CELL).agg(
        F.count(F.when(F.col("_on"), 1)).alias("tp"), F.count(F.lit(1)).alias("pos"), (F.min(F.when(F.col("_on"), F.col("t"))) - F.min("t")).alias("delay")
    )
    # a cell for every event, also for those that no row of the series lies in
    cells = total.crossJoin(F.broadcast(events.select("event_id"))).join(g, list(CELL), "left")  # series by events, both dimensions
    tp, pos = F.coalesce("tp", F.lit(0)), F.coalesce("pos", F.lit(0))
    fp, neg = F.col("_alarms") - tp, F.col("_rows") - pos
    p, r = F.when(F.col("_alarms") > 0, tp / F.col("_alarms")).otherwise(0.0), F.when(pos > 0, tp / pos).otherwise(0.0)
    far = F.when(neg > 0, fp / neg * per_year).otherwise(0.0)
    return cells.select(*CELL, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "delay", far.alias("false_alarms_per_year"))


def enhanced_metrics(alarms: DataFrame, events: DataFrame, tolerances: tuple[int, ...] = (5, 10, 30)) -> DataFrame:
    """A row a cell that holds rows: f1 at each tolerance, auc_pr, delay, false alarms a year; alarms: series_id, method, ts, t, score, alarm."""
    bounds = event_bounds(alarms, events)
    out = bounds.select(*CELL)
    on = alarms.where("alarm").select("series_id", "method", "t")
    for tol in tolerances:
        out = out.join(tolerance_f1(on, bounds, tol).select(*CELL, F.col("f1").alias(f"f1_{tol}")), list(CELL))
    out = out.join(auc_pr(alarms, events), list(CELL), "left")
    return out.join(point_metrics(alarms, events).select(*CELL, "delay", F.col("false_alarms_per_year").alias("far")), list(CELL))


def metric_summary(cells: DataFrame, columns: list[str]) -> DataFrame:
    """method, n_cells, and mean and median of each metric over cells that have it."""
    return cells.groupBy("method").agg(F.count(F.lit(1)).alias("n_cells"), *[x for c in columns for x in (F.avg(c).alias(f"mean_{c}"), F.percentile(c, F.lit(0.5)).alias(f"median_{c}"))])


def mean_difference(df: DataFrame, group: str, columns: list[str], keys: list[str]) -> DataFrame:
    """Standardised mean difference of each column between rows where `group` is true and false: keys, covariate, smd (null when flat)."""
    long = df.select(*keys, group, F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_s")).select(*keys, group, "_s.*")
    side = lambda f, yes: f(F.when(F.col(group) == F.lit(yes), F.col("x")))
    g = long.groupBy(*keys, "covariate").agg(side(F.avg, True).alias("a"), side(F.avg, False).alias("b"), side(F.var_samp, True).alias("va"), side(F.var_samp, False).alias("vb"))
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    return g.select(*keys, "covariate", F.when(pooled > FLAT, (F.col("a") - F.col("b")) / pooled).alias("smd"))


def granger(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Does x one row earlier help to tell y beyond y one row earlier: n, r2 of both regressions, F and its p.

    With one lag both R squared follow from the three correlations, so one aggregation does.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    d = df.select(*keys, F.col(y).alias("y"), F.lag(y).over(w).alias("y1"), F.lag(x).over(w).alias("x1")).where("y is not null and y1 is not null and x1 is not null")
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("y", "y1").alias("a"), F.corr("y", "x1").alias("b"), F.corr("y1", "x1").alias("c"))
    full = (F.pow("a", 2) + F.pow("b", 2) - 2 * F.col("a") * F.col("b") * F.col("c")) / (1 - F.pow("c", 2))
    g = g.withColumn("r2_own", F.pow("a", 2)).withColumn("r2", full)
    f = (F.col("r2") - F.col("r2_own")) / ((1 - F.col("r2")) / (F.col("n") - 3))
    return g.withColumn("f_stat", f).withColumn("p", f_sf(F.col("f_stat"), F.lit(1.0), F.col("n") - 3.0)).drop("a", "b", "c")


def conformal_coverage(df: DataFrame, x: str, keys: list[str], cut: Column, level: float = 0.9) -> DataFrame:
    """Split conformal intervals around the calibration mean: width (quantile of absolute residuals) and the share of later rows inside."""
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("x"), cut.alias("_fit"))
    mean = rows.where("_fit").groupBy(*keys).agg(F.avg("x").alias("centre"))
    r = rows.join(mean, keys).withColumn("_r", F.abs(F.col("x") - F.col("centre")))
    width = r.where("_fit").groupBy(*keys).agg(F.percentile("_r", F.lit(level)).alias("width"))
    return r.where("not _fit").join(width, keys).groupBy(*keys).agg(F.max("width").alias("width"), F.avg((F.col("_r") <= F.col("width")).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def near_misses(df: DataFrame, events: DataFrame, limit: float = 2.0) -> DataFrame:
    """Score statistics within near-miss windows: mean, largest, share beyond the limit, by series, method and window."""
    return event_members(df.where("score is not null"), events).groupBy(*CELL).agg(F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.avg((F.col("score") > limit).cast("double")).alias("share"))


def proximity_effect(df: DataFrame, days: DataFrame, x: str, within: int = 5, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Mean of x near marked days (within calendar days, by date) and away from them, and their difference."""
    near = days.select(F.explode(F.sequence(F.date_sub("ts", within), F.date_add("ts", within))).alias("ts")).distinct().withColumn("_near", F.lit(True))
    j = df.where(F.col(x).isNotNull()).join(near, "ts", "left")
    g = j.groupBy(*keys).agg(F.avg(F.when(F.col("_near"), F.col(x))).alias("near"), F.avg(F.when(F.col("_near").isNull(), F.col(x))).alias("far"), F.count("_near").alias("n_near"))
    return g.withColumn("effect", F.col("near") - F.col("far"))


def tail_exponent(df: DataFrame, x: str, keys: list[str], top: float = 0.1) -> DataFrame:
    """Power-law slope: log rank on log |x| over the largest share of values."""
    w = Window.partitionBy(*keys).orderBy(F.abs(x).desc())
    r = df.where(F.abs(x) > 0).withColumn("_r", F.rank().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return r.where(F.col("_r") <= F.col("_n") * top).groupBy(*keys).agg(F.regr_slope(F.log("_r"), F.log(F.abs(x))).alias("slope"), F.count(F.lit(1)).alias("n"))


def dominant_period(df: DataFrame, x: str, keys: list[str], longest: int = 64) -> DataFrame:
    """period (rows, from 2 to longest) of the largest periodogram ordinate of x less its mean, and its power."""
    c = df.where(F.col(x).isNotNull()).withColumn("_x", F.col(x) - F.avg(x).over(Window.partitionBy(*keys))).withColumn("period", F.explode(F.sequence(F.lit(2), F.lit(longest))))
    turn = 2 * 3.141592653589793 * F.col("t") / F.col("period")
    g = c.groupBy(*keys, "period").agg((F.pow(F.sum(F.col("_x") * F.cos(turn)), 2) + F.pow(F.sum(F.col("_x") * F.sin(turn)), 2)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    g = g.withColumn("power", F.round(F.col("_p") / F.col("_n"), 9))
    return g.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("power").desc(), "period"))).where("_k = 1").select(*keys, "period", "power")


def lead_time(alarms: DataFrame, starts: DataFrame, lookback: int = 252, alarm: str = "alarm") -> DataFrame:
    """lead_time (rows from the first alarm in [t0 - lookback, t0) to t0) and the number of alarm episodes there; starts: series_id, event_id, t0."""
    j = alarms.join(starts, "series_id").where((F.col("t") >= F.col("t0") - lookback) & (F.col("t") < F.col("t0")))
    w = Window.partitionBy("series_id", "event_id").orderBy("t")
    j = j.withColumn("_on", F.col(alarm) & ~F.coalesce(F.lag(alarm).over(w), F.lit(False)))
    g = j.groupBy("series_id", "event_id").agg((F.max("t0") - F.min(F.when(F.col(alarm), F.col("t")))).alias("lead_time"), F.sum(F.col("_on").cast("int")).alias("episodes"))
    return g


def signed_rank(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Wilcoxon signed-rank sums of x - y, zero differences left out."""
    d = df.withColumn("_d", F.col(x) - F.col(y)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    r = average_rank(d, "_a", keys, "_r")
    return r.groupBy(*keys).agg(F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"), F.count(F.lit(1)).alias("n"))


def partial_correlation(df: DataFrame, x: str, y: str, control: str, keys: list[str]) -> DataFrame:
    """Correlation of x and y given a control, from the three pairwise ones."""
    ok = df.where(" and ".join(f"{c} is not null" for c in (x, y, control)))
    g = ok.groupBy(*keys).agg(F.corr(x, y).alias("rxy"), F.corr(x, control).alias("rxz"), F.corr(y, control).alias("ryz"))
    return g.select(*keys, ((F.col("rxy") - F.col("rxz") * F.col("ryz")) / F.sqrt((1 - F.pow("rxz", 2)) * (1 - F.pow("ryz", 2)))).alias("partial"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    ok = df.where(f"{x} is not null and {y} is not null")
    r = average_rank(average_rank(ok, x, keys, "_rx"), y, keys, "_ry")
    return r.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"))


def mcnemar(df: DataFrame, a: str, b: str, truth: str, keys: list[str]) -> DataFrame:
    """b01, b10 and the continuity-corrected statistic of two alarms against labels."""
    ra, rb = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    g = df.groupBy(*keys).agg(F.count(F.when(ra & ~rb, 1)).alias("b10"), F.count(F.when(~ra & rb, 1)).alias("b01"))
    n = F.col("b10") + F.col("b01")
    stat = F.when(n > 0, F.pow(F.greatest(F.abs(F.col("b10") - F.col("b01")) - 1, F.lit(0)), 2) / n)
    return g.withColumn("statistic", stat).withColumn("p", chi2_sf(F.col("statistic"), F.lit(1.0)))


def calibration(df: DataFrame, p: str, label: str, keys: list[str], bins: int = 10) -> DataFrame:
    """A row a bin of predicted probability: mean prediction, share of positives, size, and the bin's part of the calibration error."""
    b = df.where(f"{p} is not null").withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int"))
    g = b.groupBy(*keys, "bin").agg(F.avg(p).alias("predicted"), F.avg(F.col(label).cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("ece_part", F.abs(F.col("predicted") - F.col("observed")) * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def score_faults(scores: DataFrame, cells: DataFrame, limit: float = 50.0) -> DataFrame:
    """Validation issues: scores beyond a limit, series that are mostly null or constant, effects that are identical across methods."""
    a = scores.where(F.abs("score") > limit).groupBy("series_id", "method").agg(F.count(F.lit(1)).alias("n")).withColumn("issue", F.lit("out_of_bounds"))
    g = scores.groupBy("series_id", "method").agg(F.count("score").alias("k"), F.count(F.lit(1)).alias("n"), F.stddev_samp("score").alias("sd"))
    b = g.where("k < 0.5 * n").select("series_id", "method", (F.col("n") - F.col("k")).alias("n"), F.lit("null_density").alias("issue"))
    c = g.where(f"k > 1 and sd <= {FLAT}").select("series_id", "method", F.col("k").alias("n"), F.lit("constant").alias("issue"))
    d = cells.where("d is not null").groupBy("series_id", "event_id", "d").agg(F.count(F.lit(1)).alias("n"), F.min("method").alias("method")).where("n > 1").select("series_id", "method", "n", F.lit("identical").alias("issue"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def claims_check(stored: DataFrame, claims: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """key, expected, value, ok: claims against stored values; a missing value is not ok."""
    j = claims.join(stored, "key", "left")
    return j.select("key", "expected", "value", F.coalesce(F.abs(F.col("expected") - F.col("value")) <= tolerance, F.lit(False)).alias("ok"))


def study(scores: DataFrame, events: DataFrame, pad: int = 0, min_before: int = 100) -> DataFrame:
    """The comparison grid: d, means and a skip flag for every (series, method, event); few earlier rows skip the cell."""
    from .joins import lower_bound

    early = lower_bound(scores.select("series_id", "ts", "t").distinct(), events).where(F.col("t0") < min_before).select("series_id", "event_id", F.lit(True).alias("skipped"))
    d = cohens_d(group_moments(scores, events, pad))
    return d.join(early, ["series_id", "event_id"], "left").withColumn("skipped", F.coalesce("skipped", F.lit(False))).withColumn("d", F.when(~F.col("skipped"), F.col("d")))
