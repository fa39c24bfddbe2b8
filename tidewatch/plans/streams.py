"""The streaming operators over the events table, replayed as a stream in three restarts, and event-time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.sources import panels as p
from tidewatch.sources.results import shared_folder
from tidewatch.streaming import online as on
from tidewatch.streaming import stateful as st

from .registry import query, rounded

#: One value a type and instant: ties in time are averaged before the fold.
BARS = "(SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, sum(value::DECIMAL(18,4))::DOUBLE / count(*) AS value FROM events GROUP BY ALL)"


def hourly(spark, sf):
    e = p.table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(18,4)").alias("v"))
    return e.groupBy("series_id", "ts").agg((F.sum("v").cast("double") / F.count("v")).alias("value"))


def streamed(spark, sf, processor):
    return st.replayed(hourly(spark, sf), processor, shared_folder(spark))


@query("st3_running_moments", f"SELECT series_id, ts, count(value) OVER w AS n, round(avg(value) OVER w, 9) + 0.0 AS mean, round(CASE WHEN count(value) OVER w > 1 THEN var_samp(value) OVER w END, 7) + 0.0 AS variance FROM {BARS} WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def _(spark, sf):
    return streamed(spark, sf, st.Welford()).select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "n", F.round("mean", 9).alias("mean"), F.round("variance", 7).alias("variance"))


@query("st11_tick_bars", "SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, count(*) AS n, round(sum(value), 4) + 0.0 AS total, round(min(value), 6) + 0.0 AS low, round(max(value), 6) + 0.0 AS high FROM events GROUP BY ALL")
def _(spark, sf):
    b = st.tick_bars(p.table(spark, sf, "events"), "event_type", "value")
    return rounded(b.withColumn("total", F.round("total", 4)).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("st11_alarm_sessions", """WITH a AS (SELECT event_type AS series_id, ts FROM events WHERE value > 150), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT series_id, min(ts) AS start, max(ts) + INTERVAL 3 HOUR AS stop, count(*) AS n FROM s GROUP BY series_id, k""")
def _(spark, sf):
    a = p.table(spark, sf, "events").where("value > 150").select(F.col("event_type").alias("series_id"), "ts")
    s = st.alarm_sessions(a, "3 hours")
    return s.select("series_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


def replay(name, processor, sql=None):
    """A processor's output; timestamps without a zone, as the SQL has them."""
    query(name, sql)(lambda spark, sf: rounded(streamed(spark, sf, processor).withColumn("ts", F.col("ts").cast("timestamp_ntz"))))


B = f"(SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1)::BIGINT AS t FROM {BARS})"
O = "OVER (PARTITION BY series_id ORDER BY t"  # noqa: E741

replay("st10_cusum", st.Cusum(), f"""WITH b AS MATERIALIZED (SELECT * FROM {B}), m AS (SELECT series_id, avg(value) AS mean, stddev_samp(value) AS sd FROM b WHERE t < 60 GROUP BY 1),
z AS (SELECT series_id, ts, t, CASE WHEN t >= 60 THEN CASE WHEN sd > 1e-12 THEN (value - mean) / sd ELSE 0 END END AS z FROM b JOIN m USING (series_id)), c AS (SELECT *, sum(z - 0.5::DOUBLE) {O}) AS p, sum(-z - 0.5::DOUBLE) {O}) AS q FROM z)
SELECT series_id, ts, round(CASE WHEN t >= 60 THEN greatest(p - least(0.0::DOUBLE, min(p) {O})), q - least(0.0::DOUBLE, min(q) {O}))) END, 6) + 0.0 AS score FROM c""")
replay("st10_ewma", st.Ewma(), f"""WITH RECURSIVE b AS MATERIALIZED (SELECT * FROM {B}), e(series_id, t, s) AS (SELECT series_id, t, value * value FROM b WHERE t = 0 UNION ALL SELECT b.series_id, b.t, 0.94::DOUBLE * e.s + 0.06::DOUBLE * b.value * b.value FROM e JOIN b ON b.series_id = e.series_id AND b.t = e.t + 1)
SELECT series_id, ts, round(sqrt(s), 6) + 0.0 AS vol FROM e JOIN b USING (series_id, t)""")
replay("st10_cool_down", st.CoolDown(60.0, 5), f"SELECT series_id, ts, max(value > 60) {O} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS in_cash FROM {B}")
replay("st8_sequential_evidence", st.Evidence(), f"""WITH RECURSIVE l AS MATERIALIZED (SELECT series_id, ts, t, CASE WHEN count(value) OVER w >= 20 THEN value / greatest(stddev_samp(value) OVER w, 1e-8) - 0.5::DOUBLE ELSE 0.0::DOUBLE END AS llr FROM {B} WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e(series_id, t, raw, kept) AS (SELECT series_id, t, 0.0::DOUBLE, 0.0::DOUBLE FROM l WHERE t = 0 UNION ALL SELECT series_id, t, raw, CASE WHEN raw >= 2.995732 OR raw <= -2.995732 THEN 0.0::DOUBLE ELSE raw END FROM (SELECT l.series_id, l.t, CASE WHEN l.t < 60 THEN 0.0::DOUBLE ELSE 0.95::DOUBLE * e.kept + l.llr END AS raw FROM e JOIN l ON l.series_id = e.series_id AND l.t = e.t + 1))
SELECT series_id, ts, round(kept, 6) + 0.0 AS evidence, raw >= 2.995732 AS alarm FROM e JOIN l USING (series_id, t)""")
replay("st2_percentile_score", st.PercentileScore(), f"""WITH b AS MATERIALIZED (SELECT * FROM {B}) SELECT a.series_id, a.ts, round(CASE WHEN count(*) >= 60 THEN 2 * abs(sum((c.value <= a.value)::INTEGER)::DOUBLE / count(*) - 0.5) END, 6) + 0.0 AS score FROM b a JOIN b c ON c.series_id = a.series_id AND c.t BETWEEN a.t - 499 AND a.t GROUP BY a.series_id, a.ts""")
replay("st9_transitions", st.Transition(5, 5.0, 10), f"""WITH RECURSIVE m AS MATERIALIZED (SELECT series_id, ts, t, abs(m - lag(m) {O})) > 5 AS hit FROM (SELECT *, avg(value) {O} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM {B})),
e(series_id, t, taken, transition) AS (SELECT series_id, t, -1000000000::BIGINT, false FROM m WHERE t = 0 UNION ALL SELECT m.series_id, m.t, CASE WHEN m.hit AND m.t - e.taken >= 10 THEN m.t ELSE e.taken END, m.hit AND m.t - e.taken >= 10 FROM e JOIN m ON m.series_id = e.series_id AND m.t = e.t + 1)
SELECT series_id, ts, transition FROM e JOIN m USING (series_id, t)""")
LL = lambda m, sd: f"-0.5::DOUBLE * ((b.value - {m}) / {sd}) ** 2 - ln({sd})"
replay("st4_bayes_filter", st.BayesFilter(), f"""WITH RECURSIVE b AS MATERIALIZED (SELECT * FROM {B}), q AS (SELECT series_id, quantile_cont(abs(value), 0.8) AS cut FROM b WHERE t < 126 GROUP BY 1),
g AS (SELECT series_id, avg(value) FILTER (abs(value) <= cut) AS m0, greatest(stddev_pop(value) FILTER (abs(value) <= cut), 1e-8) AS s0, avg(value) FILTER (abs(value) > cut) AS m1, greatest(stddev_pop(value) FILTER (abs(value) > cut), 1e-8) AS s1 FROM b JOIN q USING (series_id) WHERE t < 126 GROUP BY 1),
e(series_id, t, p) AS (SELECT series_id, 125::BIGINT, 0.1::DOUBLE FROM g UNION ALL SELECT series_id, t, least(greatest(1 / (1 + (1 - prior) / prior * exp(least(greatest(l0 - l1, -500), 500))), 0.001::DOUBLE), 0.999::DOUBLE) FROM (
 SELECT b.series_id, b.t, e.p * 0.98::DOUBLE + (1 - e.p) * (1 - 0.98::DOUBLE) AS prior, {LL('g.m0', 'g.s0')} AS l0, {LL('g.m1', 'g.s1')} AS l1 FROM e JOIN b ON b.series_id = e.series_id AND b.t = e.t + 1 JOIN g ON g.series_id = b.series_id))
SELECT b.series_id, b.ts, round(CASE WHEN b.t >= 126 THEN e.p END, 6) + 0.0 AS p_crisis FROM b LEFT JOIN e USING (series_id, t)""")


def hourly_vectors(spark, sf):
    """series_id, ts, x: an hour's value, its change, and mean, deviation and range of the last 24; null before 24 hours."""
    w = Window.partitionBy("series_id").orderBy("ts")
    day = w.rowsBetween(-23, 0)
    v = F.col("value")
    x = F.array(v, v - F.lag(v).over(w), F.avg(v).over(day), F.stddev_samp(v).over(day), F.max(v).over(day) - F.min(v).over(day))
    return hourly(spark, sf).select("series_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.count(v).over(day) == 24, x).alias("x"), "value", F.lead("value", 6).over(w).alias("later"), F.avg(v).over(w.rowsBetween(1, 6)).alias("next"))


def online_model(name, make):
    def run(spark, sf):
        x = hourly_vectors(spark, sf).select("series_id", "ts", "x", F.lit(None).cast("double").alias("label"), F.col("ts").alias("arrives"))
        out = on.replayed({"x": x}, lambda s: on.stream(s["x"], make, "6 hours"), on.schema(make), shared_folder(spark))
        arrays = [c for c, t in out.dtypes if t == "array<double>"]
        out = out.withColumns({c: F.transform(c, lambda v: F.round(v, 5)) for c in arrays})
        return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 5)

    query(name)(run)


online_model("st1_online_geometry", on.OnlineGeometry)
online_model("st5_online_markov", on.OnlineHiddenMarkov)


online_model("st10_online_changepoints", on.OnlineChangepoints)
online_model("st4_online_regimes", on.OnlineRegimes)

SIZE = 5
#: Moments of decimals often lie halfway between two rounded values, where two engines' last bits decide.
NUDGE = 1.2345678e-6
PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
VECTORS = f"""(SELECT series_id, ts, CASE WHEN count(value) OVER d = 24 THEN [value, value - lag(value) OVER w, avg(value) OVER d, stddev_samp(value) OVER d, max(value) OVER d - min(value) OVER d] END AS x
 FROM {BARS} WINDOW w AS (PARTITION BY series_id ORDER BY ts), d AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


@query("st3_vector_moments", "SELECT series_id, ts, count(x) OVER w AS n, " + ", ".join(f"round(avg(x[{i + 1}]) OVER w + {NUDGE}, 5) AS mean_{i}" for i in range(SIZE)) + ", " + ", ".join(f"round(covar_samp(x[{i + 1}], x[{j + 1}]) OVER w + {NUDGE}, 5) AS cov_{i}{j}" for i, j in PAIRS) + f" FROM {VECTORS} WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def _(spark, sf):
    x = hourly_vectors(spark, sf).select("series_id", "ts", "x", F.lit(None).cast("double").alias("label"), F.col("ts").alias("arrives"))
    out = on.replayed({"x": x}, lambda s: on.stream(s["x"], on.OnlineMoments, "6 hours"), on.schema(on.OnlineMoments), shared_folder(spark))
    parts = [(F.element_at("mean", i + 1) + NUDGE).alias(f"mean_{i}") for i in range(SIZE)] + [(F.element_at("cov", k + 1) + NUDGE).alias(f"cov_{i}{j}") for k, (i, j) in enumerate(PAIRS)]
    return rounded(out.select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "n", *parts), 5)


def labelled_model(make, x, spark):
    """Rows (series_id, ts, x, value, later, next) with their labels from a second stream (see st6_online_logistic) through a model."""
    labels = x.where("later is not null").select("series_id", "ts", (F.col("next") > F.col("value")).cast("double").alias("label"))
    slow = F.pmod(F.xxhash64("series_id", "ts"), F.lit(10)) == 0
    labels = labels.withColumn("arrives", F.col("ts") + F.when(slow, F.expr("interval 20 days")).otherwise(F.expr("interval 7 hours")))
    features = x.select("series_id", "ts", "x", F.col("ts").alias("arrives"))
    out = on.replayed({"x": features, "y": labels}, lambda s: on.stream(on.labelled_stream(s["x"], s["y"], "12 hours"), make, None), on.schema(make), shared_folder(spark))
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("st7_online_stacking")
def _(spark, sf):
    """Three scores of an hour (its places among the last day's and week's values, and its distance from the day's mean) stacked into one."""
    w = Window.partitionBy("series_id").orderBy("ts")
    v = F.col("value")
    place = lambda n: (v - F.min(v).over(w.rowsBetween(1 - n, 0))) / F.nullif(F.max(v).over(w.rowsBetween(1 - n, 0)) - F.min(v).over(w.rowsBetween(1 - n, 0)), F.lit(0.0))
    z = (v - F.avg(v).over(w.rowsBetween(-23, 0))) / F.nullif(F.stddev_samp(v).over(w.rowsBetween(-23, 0)), F.lit(0.0))
    return labelled_model(on.OnlineStacking, hourly_vectors(spark, sf).withColumn("x", F.array(place(24), place(168), 1 / (1 + F.exp(-z)))), spark)


@query("st6_online_logistic")
def _(spark, sf):
    """Will the next six hours' mean be above the value now? The label comes seven hours later from a second stream; some labels come too late to count."""
    return labelled_model(on.OnlineLogistic, hourly_vectors(spark, sf), spark)
