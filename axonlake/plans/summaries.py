"""Aggregations, statistics and ordered analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.functions.cells import wrapped
from axonlake.operators import edges as E
from axonlake.operators import ordered as O
from axonlake.operators import stats as S
from axonlake.plans.views import SQL_EDGES, SQL_NODES, SQL_TRIALS, edges, nodes, sql, trials
from axonlake.sources.tables import table

PI = 3.141592653589793
r6 = lambda c, name: F.round(c, 6).alias(name)


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def a3_by_keys(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).groupBy("arm", "task", "k").agg(F.count("acc").alias("n"), F.round(F.avg("acc"), 9).alias("mean_acc"), F.max("val").alias("best_val"))


def a4_null_kept(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy("cell_sub_class").agg(F.count(F.lit(1)).alias("n"))


def a5_value_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = nodes(spark, d).where("top_nt IS NOT NULL").groupBy("top_nt").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "top_nt").limit(20)


def a6_shares(spark: SparkSession, d: str) -> DataFrame:
    per = edges(spark, d).groupBy("np").agg(F.sum("w").alias("w"))
    total = per.agg(F.sum("w").alias("t"))  # one row
    return per.crossJoin(F.broadcast(total)).select("np", "w", r6(F.col("w") * 100.0 / F.col("t"), "percent"))


def a7_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Per place: smallest, mean, median and largest pair weight; weights are counted first, so the median reads (value, count) rows."""
    e = edges(spark, d)
    counts = e.groupBy("np", "w").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("np").agg(F.min("w").alias("least"), r6(F.sum(F.col("w") * F.col("n")) / F.sum("n"), "mean"), F.expr("percentile(w, 0.5, n)").alias("median"), F.max("w").alias("most"))


def a8_class_matrix(spark: SparkSession, d: str) -> DataFrame:
    return E.class_matrix(E.pairs(edges(spark, d)), nodes(spark, d), "super_class")


def a9_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.pairs(edges(spark, d), F.count(F.lit(1)).alias("n"))


def a10_top_labels(spark: SparkSession, d: str) -> DataFrame:
    w = edges(spark, d).groupBy("post").agg(F.sum("w").alias("w"))
    by = w.join(nodes(spark, d).select(F.col("id").alias("post"), "label"), "post").groupBy("label").agg(F.sum("w").alias("w"))
    return by.orderBy(F.desc("w"), "label").limit(12)


def a11_downstream(spark: SparkSession, d: str) -> DataFrame:
    e, n = edges(spark, d), nodes(spark, d)
    inputs = n.where("super_class = 'sensory'").select("id")
    w = E.within(e, "pre", inputs).groupBy("post").agg(F.sum("w").alias("w")).join(inputs.select(F.col("id").alias("post")), "post", "left_anti")
    by = w.join(n.select(F.col("id").alias("post"), "label"), "post").groupBy("label").agg(F.sum("w").alias("w"))
    return by.orderBy(F.desc("w"), "label").limit(12)


def a12_ci(spark: SparkSession, d: str) -> DataFrame:
    got = trials(spark, d).groupBy("arm").agg(*S.mean_ci("acc"))
    return got.where("n > 0").select("arm", "n", *[r6(F.col(c), c) for c in ("mean", "sd", "ci95")])


def a13_apart(spark: SparkSession, d: str) -> DataFrame:
    ci = trials(spark, d).where("acc IS NOT NULL").groupBy("arm").agg(*S.mean_ci("acc")).select("arm", (F.col("mean") - F.col("ci95")).alias("lo"), (F.col("mean") + F.col("ci95")).alias("hi"))
    a, b = ci.alias("a"), ci.alias("b")  # one row per arm
    return a.join(b, F.col("a.arm") < F.col("b.arm")).select(F.col("a.arm").alias("arm_a"), F.col("b.arm").alias("arm_b"), S.apart(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi")).alias("apart"))


def a14_wilson(spark: SparkSession, d: str) -> DataFrame:
    per = trials(spark, d).where("acc IS NOT NULL").groupBy("arm", "task").agg(F.count_if(F.col("acc") >= 0.9).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return per.select("arm", "task", "k", "n", r6(lo, "low"), r6(hi, "high"))


def a15_grid(spark: SparkSession, d: str) -> DataFrame:
    per = trials(spark, d).where("acc IS NOT NULL").groupBy("arm", "k").agg(F.avg("acc").alias("m"))
    return O.never_rises(per, ["arm"], "k", "m")


def a16_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Bits of each target's inputs over classes; inputs without a class don't count."""
    cls = nodes(spark, d).where("cell_class IS NOT NULL").select(F.col("id").alias("pre"), "cell_class")
    counts = edges(spark, d).join(cls, "pre").groupBy("post", "cell_class").agg(F.count(F.lit(1)).alias("n"))
    return S.entropy_bits(counts, ["post"], "n").select("post", r6(F.abs("bits"), "bits"))


def a17_information(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    rows = edges(spark, d).join(n.select(F.col("id").alias("pre"), F.col("super_class").alias("a")), "pre").join(n.select(F.col("id").alias("post"), F.col("super_class").alias("b")), "post")
    counts = rows.where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return S.mutual_information_bits(counts, "a", "b", "n").select(r6(F.col("bits"), "bits"))


def a18_shared_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Mean number of common inputs of two targets, from the sources' degrees: (sum d^2 - E) / (n (n - 1))."""
    once = edges(spark, d).select("pre", "post").distinct()
    deg = once.groupBy("pre").agg(F.count(F.lit(1)).alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum("d").alias("e"))
    n = once.select("post").distinct().agg(F.count(F.lit(1)).alias("n"))
    return deg.crossJoin(n).select(r6((F.col("dd") - F.col("e")) / (F.col("n") * (F.col("n") - 1)), "shared"))  # one row each


def a19_both_flags(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy("side").agg(F.count_if((F.col("super_class") == "optic") & (F.col("sign_a") == -1)).alias("n_both"), F.count_if(F.col("sign_b").isNull()).alias("n_unsigned"))


def a20_degrees(spark: SparkSession, d: str) -> DataFrame:
    deg = E.degrees(edges(spark, d))
    alone = nodes(spark, d).select("id").join(deg.select("id"), "id", "left_anti").select("id", *[F.lit(0).cast("long").alias(c) for c in ("n_out", "n_in", "w_out", "w_in")])
    return deg.unionByName(alone)


def a21_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per place: cells, pairs, synapses, share of returned pairs, and of exciting, inhibiting and unsigned sources."""
    e = edges(spark, d).where("np IS NOT NULL")
    p = e.groupBy("np", "pre", "post").agg(F.sum("w").alias("w"))
    back = p.select("np", F.col("post").alias("pre"), F.col("pre").alias("post"), F.lit(1).alias("r"))
    sums = p.join(back, ["np", "pre", "post"], "left").groupBy("np").agg(F.count(F.lit(1)).alias("pairs"), F.sum("w").alias("synapses"), r6(F.count("r") / F.count(F.lit(1)), "returned"))
    cells = p.select("np", F.col("pre").alias("id")).union(p.select("np", "post")).distinct()
    signs = cells.join(nodes(spark, d).select("id", "sign_b"), "id", "left").groupBy("np").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("sign_b") == 1).alias("n_plus"), F.count_if(F.col("sign_b") == -1).alias("n_minus"), F.count_if(F.col("sign_b").isNull()).alias("n_unknown")
    )
    return sums.join(signs, "np")


def a22_accuracy(spark: SparkSession, d: str) -> DataFrame:
    per = trials(spark, d).where("acc IS NOT NULL").groupBy("task").agg(S.guarded_corr("k", "acc").alias("r"), r6(F.avg("acc"), "acc"), F.count(F.lit(1)).alias("n"))
    return per.select("task", r6(F.col("r"), "r"), "acc", "n")


def a23_decay(spark: SparkSession, d: str) -> DataFrame:
    """Mean accuracy by length k beside what independent steps would give, p^k with p that of the shortest length."""
    per = trials(spark, d).where("task = 'T3' AND acc IS NOT NULL").groupBy("k").agg(F.avg("acc").alias("acc"))
    base = per.agg(F.min_by("acc", "k").alias("p"), F.min("k").alias("k0"))
    return per.crossJoin(F.broadcast(base)).select("k", r6(F.col("acc"), "acc"), r6(F.pow("p", F.col("k") / F.col("k0")), "expected"))


def a24_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Settings whose trials agree in all columns given but not in the target."""
    t = trials(spark, d).where("target IS NOT NULL")
    per = t.groupBy("arm", "seed", "task", "h").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("n_targets"))
    return per.where("n_targets > 1")


def a26_first_below(spark: SparkSession, d: str) -> DataFrame:
    """The first k of each arm whose mean accuracy is below 0.5."""
    per = trials(spark, d).where("acc IS NOT NULL").groupBy("arm", "k").agg(F.avg("acc").alias("m"))
    return per.where("m < 0.5").groupBy("arm").agg(F.min("k").alias("k"))


def a27_label_counts(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    sums = n.groupBy("super_class").agg(F.count_if(F.col("cell_type").isNotNull()).alias("typed"), F.count_if(F.col("known_nt").isNotNull()).alias("nt_known"), F.count_if(F.col("soma_x").isNotNull()).alias("soma"))
    return sums.select("super_class", F.expr("stack(3, 'typed', typed, 'nt_known', nt_known, 'soma', soma) AS (what, n)"))


def a28_directions(spark: SparkSession, d: str) -> DataFrame:
    """Mean time of day and its concentration per event type, plain and weighted by value."""
    ev = events(spark, d).withColumn("theta", (F.hour("ts") * 60 + F.minute("ts")) * (2 * PI / 1440))
    plain = ev.groupBy("event_type").agg(*S.circular("theta"))
    weighted = ev.groupBy("event_type").agg(*S.circular("theta", F.col("value"))).select("event_type", r6(F.col("resultant"), "w_resultant"))
    return plain.select("event_type", r6(F.col("direction"), "direction"), r6(F.col("resultant"), "resultant")).join(weighted, "event_type")


def a29_synaptic_events(spark: SparkSession, d: str) -> DataFrame:
    """Synaptic events by super class when every cell fires as often as it has inputs: sum over cells of firings times outgoing absolute weight."""
    e = edges(spark, d)
    out = e.groupBy("pre").agg(F.sum(F.abs("w")).alias("w"))
    fired = e.groupBy(F.col("post").alias("pre")).agg(F.count(F.lit(1)).alias("s"))
    cells = nodes(spark, d).select(F.col("id").alias("pre"), "super_class")
    return cells.join(out, "pre").join(fired, "pre").groupBy("super_class").agg(F.sum(F.col("s") * F.col("w")).alias("events"))


def a30_dense_updates(spark: SparkSession, d: str) -> DataFrame:
    """What a dense update costs per place: the synapses between cells that are active there (a row of weight 20 or more at either end), for as many ticks as it has such rows; all synapses where none is active."""
    e = edges(spark, d).where("np IS NOT NULL")
    strong = e.where("w >= 20")
    active = strong.select("np", F.col("pre").alias("id")).unionAll(strong.select("np", "post")).distinct()
    a, b = active.select("np", F.col("id").alias("pre"), F.lit(True).alias("a")), active.select("np", F.col("id").alias("post"), F.lit(True).alias("b"))
    per = e.join(a, ["np", "pre"], "left").join(b, ["np", "post"], "left").groupBy("np").agg(F.sum(F.abs("w")).alias("whole"), F.sum(F.when(F.col("a") & F.col("b"), F.abs("w"))).alias("between"), F.count_if(F.col("w") >= 20).alias("ticks"))
    return per.select("np", F.when(F.col("ticks") > 0, F.coalesce("between", F.lit(0)) * F.col("ticks")).otherwise(F.col("whole")).alias("updates"))


def g31_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which checks of the tables hold: (name, n rows against it, holds)."""
    e, n = edges(spark, d), nodes(spark, d)
    known = n.select("id").distinct()
    against = {
        "weights are positive": e.where("w < 1"), "no self-loops": e.where("pre = post"), "sources are known": e.join(known.withColumnRenamed("id", "pre"), "pre", "left_anti"),
        "targets are known": e.join(known.withColumnRenamed("id", "post"), "post", "left_anti"), "ids are single": n.groupBy("id").count().where("count > 1"),
    }
    rows = None
    for name, bad in against.items():
        one = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") == 0).alias("holds"))
        rows = one if rows is None else rows.unionAll(one)
    return rows


def a31_saturation(spark: SparkSession, d: str) -> DataFrame:
    """Mean saturation and activity of trials, and how many run saturated, by arm."""
    t = trials(spark, d)
    return t.groupBy("arm").agg(F.count("sat").alias("n"), r6(F.avg("sat"), "saturation"), r6(F.avg("activity"), "activity"), F.count_if(F.col("sat") > 0.5).alias("n_saturated"))


def g18_correlation(spark: SparkSession, d: str) -> DataFrame:
    """How cells' angles by position and by soma vary together around the middle, by side."""
    ok = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("pos_x", "pos_y", "soma_x", "soma_y"))
    n = nodes(spark, d).where(ok).select("side", F.atan2(F.col("pos_y") - 60000.0, F.col("pos_x") - 130000.0).alias("a"), F.atan2(F.col("soma_y") - 60000.0, F.col("soma_x") - 130000.0).alias("b"))
    return S.circular_correlation(n, "a", "b", ["side"]).select("side", "n", F.round("r", 6).alias("r"))


def l15_accepted(spark: SparkSession, d: str) -> DataFrame:
    """The seeds of each arm whose best accuracy over all tasks is 1, within 1e-8."""
    return trials(spark, d).where("acc IS NOT NULL").groupBy("arm", "seed").agg(F.max("acc").alias("best")).where("abs(best - 1) < 1e-8").select("arm", "seed")


def t7_queue(spark: SparkSession, d: str) -> DataFrame:
    """Each day's events in the order they are served: by priority of their kind, then by arrival."""
    priority = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    rows = events(spark, d).select(F.to_date("ts").alias("day"), priority.alias("priority"), "ts", "event_id", F.lit(1).alias("one"))
    return O.running_total(rows, ["day"], ["priority", "ts", "event_id"], "one", "turn").select(F.col("day").cast("string").alias("day"), "event_id", F.col("turn").cast("long").alias("turn"))


def a31_state(spark: SparkSession, d: str) -> DataFrame:
    """Participation ratio tr(C)^2 / |C|^2 of three coordinates per class, without eigenvalues."""
    n = nodes(spark, d).where("pos_x IS NOT NULL AND pos_y IS NOT NULL AND pos_z IS NOT NULL AND NOT isnan(pos_x) AND NOT isnan(pos_y) AND NOT isnan(pos_z)")
    c = {(a, b): F.covar_pop(f"pos_{a}", f"pos_{b}") for a in "xyz" for b in "xyz" if a <= b}
    per = n.groupBy("cell_class").agg(F.count(F.lit(1)).alias("n"), *[v.alias(a + b) for (a, b), v in c.items()])
    trace = F.col("xx") + F.col("yy") + F.col("zz")
    norm = sum((F.col(a + b) * F.col(a + b) * (1 if a == b else 2) for a, b in c), F.lit(0.0))
    return per.where("n > 1").select("cell_class", "n", F.round(trace * trace / F.nullif(norm, F.lit(0.0)), 5).alias("participation"))


def a35_floor(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d).where("acc IS NOT NULL AND chance IS NOT NULL")
    return t.groupBy("arm").agg(r6(F.avg("acc"), "mean"), F.max("acc").alias("most"), r6(F.min(F.col("acc") - F.col("chance")), "margin"), F.count_if(F.col("acc") > F.col("chance")).alias("above"))


def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where("flow IS NOT NULL AND side IS NOT NULL").cube("flow", "side").agg(F.count(F.lit(1)).alias("n"))


def w1_top2(spark: SparkSession, d: str) -> DataFrame:
    p = E.pairs(edges(spark, d))
    k = F.row_number().over(Window.partitionBy("post").orderBy(F.desc("w"), "pre"))
    return p.withColumn("place", k).where("place <= 2")


def w2_argmax(spark: SparkSession, d: str) -> DataFrame:
    return E.strongest(E.pairs(edges(spark, d)), "post", "pre")


def w3_ranks(spark: SparkSession, d: str) -> DataFrame:
    return S.rank_of_values(trials(spark, d), ["task"], "acc")


def w4_spearman(spark: SparkSession, d: str) -> DataFrame:
    got = S.spearman(trials(spark, d), ["arm"], "acc", "val")
    return got.select("arm", r6(F.col("rho"), "rho"))


def w5_holm(spark: SparkSession, d: str) -> DataFrame:
    """p-values: the share of an arm's trials of a task at or above 0.9, as a family per task."""
    p = trials(spark, d).where("acc IS NOT NULL").groupBy("task", "arm").agg(F.round((1 + F.count_if(F.col("acc") >= 0.9)) / (1 + F.count(F.lit(1))), 9).alias("p"))
    return S.holm(p, "p", ["task"]).select("task", "arm", "p", r6(F.col("p_holm"), "p_holm"))


def w6_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The largest empty time of day of each user with 2 events or more."""
    ev = events(spark, d).select("user_id", ((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) * (2 * PI / 86400)).alias("theta"))
    return O.circular_gaps(ev, ["user_id"], "theta").select("user_id", "n", r6(F.col("max_gap"), "max_gap"))


def w7_clusters(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d).select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return O.clusters(ev, ["user_id"], "s", 6 * 3600)


def w8_plateau(spark: SparkSession, d: str) -> DataFrame:
    """The longest stretch of lengths k at which an arm's mean accuracy is 0.4 or more."""
    per = trials(spark, d).where("acc IS NOT NULL").groupBy("arm", "k").agg(F.avg("acc").alias("m"))
    return O.widest_run(per, ["arm"], "k", F.col("m") >= 0.4)


def w9_running(spark: SparkSession, d: str) -> DataFrame:
    day = events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return day.withColumn("so_far", F.least(F.sum("n").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1000)))


def w10_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Where the mean accuracy of an arm rises through 0.5, the steepest place of each."""
    per = trials(spark, d).where("acc IS NOT NULL").groupBy("arm", "k").agg((F.avg("acc") - 0.5).alias("y"))
    c = O.crossings(per, ["arm"], "k", "y")
    best = c.groupBy("arm").agg(F.max(F.struct("slope", (-F.col("at")).alias("m"))).alias("b"))
    return best.select("arm", r6(-F.col("b.m"), "crossing"), r6(F.col("b.slope"), "slope"))


def w12_path(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d).select("user_id", "event_id", (F.col("value") / 100 - 2.5).alias("turn"), F.lit(1.0).alias("speed"))
    return O.path(ev, ["user_id"], "event_id", "turn", "speed", 0.1).select("user_id", "event_id", F.round("heading", 5).alias("heading"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def w14_first_reaching(spark: SparkSession, d: str) -> DataFrame:
    per = trials(spark, d).where("acc IS NOT NULL").groupBy("arm", "task", "k").agg(F.avg("acc").alias("m"))
    return per.groupBy("arm", "task").agg(F.min(F.when(F.col("m") >= 0.45, F.col("k"))).alias("k"))


def w15_stride(spark: SparkSession, d: str) -> DataFrame:
    """Every 10th cell of each super class in order of id."""
    rows = O.running_total(nodes(spark, d).select("super_class", "id", F.lit(1).alias("one")), ["super_class"], ["id"], "one", "k")
    return rows.select("super_class", "id", F.col("k").cast("int").alias("k")).where("(k - 1) % 10 = 0")


def t6_best_setting(spark: SparkSession, d: str) -> DataFrame:
    """Best setting of each arm: accuracy to 9 digits, then validation, then the smaller lambda, then the smaller k."""
    per = trials(spark, d).where("acc IS NOT NULL").groupBy("arm", "task", "k", "lam").agg(F.round(F.avg("acc"), 9).alias("acc"), F.round(F.avg("val"), 9).alias("val"))
    best = per.groupBy("arm").agg(F.min(F.struct((-F.col("acc")).alias("a"), F.coalesce(-F.col("val"), F.lit(9.0)).alias("v"), F.coalesce("lam", F.lit(-1.0)).alias("lam"), "k", "task")).alias("b"))
    return best.select("arm", F.round(-F.col("b.a"), 6).alias("acc"), "b.lam", "b.k", "b.task")


def g16_permutation_p(spark: SparkSession, d: str) -> DataFrame:
    """Each seed's mean as one null sample of its arm, against the arm's best seed."""
    per = trials(spark, d).where("acc IS NOT NULL").groupBy("arm", "seed").agg(F.round(F.avg("acc"), 9).alias("x"))
    o = per.groupBy("arm").agg(F.max("x").alias("obs"), F.avg("x").alias("mu"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"))
    rows = per.join(o, "arm")
    got = rows.groupBy("arm", "obs", "mu", "sd").agg(F.count_if(F.abs(F.col("x") - F.col("mu")) >= F.abs(F.col("obs") - F.col("mu")) - 1e-12).alias("far"), F.count(F.lit(1)).alias("n"))
    return got.select("arm", "n", r6((1 + F.col("far")) / (F.col("n") + 1), "p"), r6((F.col("obs") - F.col("mu")) / F.nullif("sd", F.lit(0.0)), "z"))


def g17_welch(spark: SparkSession, d: str) -> DataFrame:
    per = trials(spark, d).where("acc IS NOT NULL").groupBy("arm").agg(F.count("acc").cast("double").alias("n"), F.avg("acc").alias("m"), F.stddev_samp("acc").alias("s")).where("n > 1")
    a, b = per.alias("a"), per.alias("b")  # one row per arm
    t, df = S.welch(*[F.col(f"a.{c}") for c in "nms"], *[F.col(f"b.{c}") for c in "nms"])
    return a.join(b, F.col("a.arm") < F.col("b.arm")).select(F.col("a.arm").alias("arm_a"), F.col("b.arm").alias("arm_b"), F.round(t, 5).alias("t"), F.round(df, 3).alias("df"))


def g18_differences(spark: SparkSession, d: str) -> DataFrame:
    """Circular difference of the mean times of day of every two event types."""
    m = a28_directions(spark, d).select("event_type", "direction")
    a, b = m.alias("a"), m.alias("b")  # one row per type
    return a.join(b, F.col("a.event_type") < F.col("b.event_type")).select(F.col("a.event_type").alias("type_a"), F.col("b.event_type").alias("type_b"), F.round(wrapped(F.col("a.direction") - F.col("b.direction")), 5).alias("diff"))


def r16_sliding(spark: SparkSession, d: str) -> DataFrame:
    """40-minute windows every 10 minutes over a fixed axis of one day; empty windows stay."""
    ev = events(spark, d).select((F.unix_seconds(F.col("ts").cast("timestamp")) / 60.0 - 28401120.0).alias("t"), "value")
    spine = spark.range(0, 145).select((F.col("id") * 10.0).alias("c"))
    return O.sliding(spine, ev, [], "t", 20.0, 10.0).groupBy("c").agg(F.count("value").alias("n"), r6(F.coalesce(F.sum("value"), F.lit(0.0)), "total"))


def r17_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user end after 6 hours without an event."""
    ev = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    s = ev.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


def l10_baselines(spark: SparkSession, d: str) -> DataFrame:
    counts = nodes(spark, d).where("super_class IS NOT NULL AND cell_class IS NOT NULL").groupBy("super_class", "cell_class").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("super_class").agg(r6(F.max("n") / F.sum("n"), "majority"), F.count(F.lit(1)).alias("n_classes"), r6(1.0 / F.count(F.lit(1)), "chance"))


QUERIES = {f.__name__: f for f in (
    a3_by_keys, a4_null_kept, a5_value_counts, a6_shares, a7_scalars, a8_class_matrix, a9_pairs, a10_top_labels, a11_downstream, a12_ci, a13_apart, a14_wilson, a15_grid, a16_entropy, a17_information,
    a18_shared_inputs, a19_both_flags, a20_degrees, a21_metrics, a22_accuracy, a23_decay, a24_conflicts, a26_first_below, a27_label_counts, a28_directions, a29_synaptic_events, a30_dense_updates, a31_state, a31_saturation, g31_checks, g18_correlation, l15_accepted, t7_queue, a35_floor, cube_counts,
    w1_top2, w2_argmax, w3_ranks, w4_spearman, w5_holm, w6_gaps, w7_clusters, w8_plateau, w9_running, w10_crossings, w12_path, w14_first_reaching, w15_stride, t6_best_setting,
    g16_permutation_p, g17_welch, g18_differences, r16_sliding, r17_sessions, l10_baselines,
)}

EN, T = sql(SQL_EDGES, SQL_NODES), sql(SQL_TRIALS)
P = ", p AS (SELECT pre, post, sum(w) AS w, count(*) AS n FROM edges GROUP BY 1, 2)"
KM = ", per AS (SELECT arm, k, avg(acc) AS m FROM runs WHERE acc IS NOT NULL GROUP BY 1, 2)"
DIRS = """m AS (SELECT event_type, atan2(sum(sin(th)), sum(cos(th))) AS dir, sqrt(sum(sin(th))**2 + sum(cos(th))**2) / count(*) AS res,
    sqrt(sum(value * sin(th))**2 + sum(value * cos(th))**2) / sum(value) AS wres
    FROM (SELECT event_type, value, (hour(ts) * 60 + minute(ts)) * (2 * pi() / 1440) AS th FROM events) GROUP BY 1)"""
CI = ", ci AS (SELECT arm, count(acc) AS n, avg(acc) AS mean, coalesce(stddev_samp(acc), 0) AS sd, 1.96 * coalesce(stddev_samp(acc), 0) / sqrt(count(acc)) AS ci95 FROM runs WHERE acc IS NOT NULL GROUP BY 1)"
SQL = {
    "a3_by_keys": T + " SELECT arm, task, k, count(acc) AS n, round(avg(acc), 9) AS mean_acc, max(val) AS best_val FROM runs GROUP BY 1, 2, 3",
    "a4_null_kept": sql(SQL_NODES) + " SELECT cell_sub_class, count(*) AS n FROM nodes GROUP BY 1",
    "a5_value_counts": sql(SQL_NODES) + " SELECT top_nt, count(*) AS n FROM nodes WHERE top_nt IS NOT NULL GROUP BY 1 ORDER BY n DESC, top_nt LIMIT 20",
    "a6_shares": sql(SQL_EDGES) + " SELECT np, CAST(sum(w) AS BIGINT) AS w, round(sum(w) * 100.0 / sum(sum(w)) OVER (), 6) AS percent FROM edges GROUP BY 1",
    "a7_scalars": sql(SQL_EDGES) + " SELECT np, min(w) AS least, round(avg(w), 6) AS mean, quantile_cont(w, 0.5) AS median, max(w) AS most FROM edges GROUP BY 1",
    "a8_class_matrix": EN + P + """ SELECT a.super_class AS from_kind, b.super_class AS to_kind, count(*) AS n, CAST(sum(w) AS BIGINT) AS syn, quantile_cont(CAST(w AS BIGINT), 0.5) AS median_w, count(DISTINCT pre) AS n_pre
        FROM p JOIN nodes a ON a.id = pre JOIN nodes b ON b.id = post WHERE a.super_class IS NOT NULL AND b.super_class IS NOT NULL GROUP BY 1, 2""",
    "a9_pairs": sql(SQL_EDGES) + P + " SELECT pre, post, CAST(w AS BIGINT) AS w, n FROM p",
    "a10_top_labels": EN + " SELECT label, CAST(sum(w) AS BIGINT) AS w FROM edges JOIN nodes ON id = post GROUP BY 1 ORDER BY w DESC, label LIMIT 12",
    "a11_downstream": EN + """, i AS (SELECT id FROM nodes WHERE super_class = 'sensory')
        SELECT label, CAST(sum(w) AS BIGINT) AS w FROM edges JOIN nodes ON id = post WHERE pre IN (SELECT id FROM i) AND post NOT IN (SELECT id FROM i) GROUP BY 1 ORDER BY w DESC, label LIMIT 12""",
    "a12_ci": T + CI + " SELECT arm, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(ci95, 6) AS ci95 FROM ci",
    "a13_apart": T + CI + " SELECT a.arm AS arm_a, b.arm AS arm_b, a.mean + a.ci95 < b.mean - b.ci95 OR b.mean + b.ci95 < a.mean - a.ci95 AS apart FROM ci a JOIN ci b ON a.arm < b.arm",
    "a14_wilson": T + """, c AS (SELECT arm, task, count(*) FILTER (acc >= 0.9) AS k, count(*) AS n FROM runs WHERE acc IS NOT NULL GROUP BY 1, 2), q AS (SELECT *, k / n AS p, 3.8416 / n AS zz FROM c)
        SELECT arm, task, k, n, round(greatest(0, (p + zz / 2 - 1.96 * sqrt(p * (1 - p) / n + zz / 4 / n)) / (1 + zz)), 6) AS low, round(least(1, (p + zz / 2 + 1.96 * sqrt(p * (1 - p) / n + zz / 4 / n)) / (1 + zz)), 6) AS high FROM q""",
    "a15_grid": T + KM + ", s AS (SELECT arm, m - lag(m) OVER (PARTITION BY arm ORDER BY k) AS s FROM per) SELECT arm, coalesce(bool_and(s <= 0), true) AS falls FROM s GROUP BY 1",
    "a16_entropy": EN + """, c AS (SELECT post, cell_class, count(*) AS n FROM edges JOIN nodes ON id = pre WHERE cell_class IS NOT NULL GROUP BY 1, 2), q AS (SELECT post, n / sum(n) OVER (PARTITION BY post) AS q FROM c)
        SELECT post, round(abs(-sum(q * log2(q))), 6) AS bits FROM q GROUP BY 1""",
    "a17_information": EN + """, c AS (SELECT a.super_class AS a, b.super_class AS b, count(*) AS n FROM edges JOIN nodes a ON a.id = pre JOIN nodes b ON b.id = post WHERE a.super_class IS NOT NULL AND b.super_class IS NOT NULL GROUP BY 1, 2),
        q AS (SELECT n / sum(n) OVER () AS j, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM c) SELECT round(sum(j * log2(j / (pa * pb))), 6) AS bits FROM q""",
    "a18_shared_inputs": sql(SQL_EDGES) + """, o AS (SELECT DISTINCT pre, post FROM edges), dg AS (SELECT count(*) AS d FROM o GROUP BY pre)
        SELECT round((sum(d * d) - sum(d)) / ((SELECT count(DISTINCT post) FROM o) * ((SELECT count(DISTINCT post) FROM o) - 1)), 6) AS shared FROM dg""",
    "a19_both_flags": sql(SQL_NODES) + " SELECT side, count(*) FILTER (super_class = 'optic' AND sign_a = -1) AS n_both, count(*) FILTER (sign_b IS NULL) AS n_unsigned FROM nodes GROUP BY 1",
    "a20_degrees": EN + """, r AS (SELECT pre AS id, 1 AS o, 0 AS i, w AS wo, 0 AS wi FROM edges UNION ALL SELECT post, 0, 1, 0, w FROM edges UNION ALL SELECT id, 0, 0, 0, 0 FROM nodes)
        SELECT id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(wo) AS BIGINT) AS w_out, CAST(sum(wi) AS BIGINT) AS w_in FROM r GROUP BY 1""",
    "a21_metrics": EN + """, q AS (SELECT np, pre, post, sum(w) AS w FROM edges WHERE np IS NOT NULL GROUP BY 1, 2, 3),
        s AS (SELECT a.np, count(*) AS pairs, CAST(sum(a.w) AS BIGINT) AS synapses, round(count(b.pre) / count(*), 6) AS returned FROM q a LEFT JOIN q b ON a.np = b.np AND a.pre = b.post AND a.post = b.pre GROUP BY 1),
        c AS (SELECT np, pre AS id FROM q UNION SELECT np, post FROM q),
        g AS (SELECT np, count(*) AS cells, count(*) FILTER (sign_b = 1) AS n_plus, count(*) FILTER (sign_b = -1) AS n_minus, count(*) FILTER (sign_b IS NULL) AS n_unknown FROM c LEFT JOIN nodes USING (id) GROUP BY 1)
        SELECT * FROM s JOIN g USING (np)""",
    "a22_accuracy": T + " SELECT task, round(CASE WHEN var_pop(k) > 0 AND var_pop(acc) > 0 THEN covar_pop(k, acc) / (stddev_pop(k) * stddev_pop(acc)) END, 6) AS r, round(avg(acc), 6) AS acc, count(*) AS n FROM runs WHERE acc IS NOT NULL GROUP BY 1",
    "a23_decay": T + """, q AS (SELECT k, avg(acc) AS acc FROM runs WHERE task = 'T3' AND acc IS NOT NULL GROUP BY 1)
        SELECT k, round(acc, 6) AS acc, round(pow((SELECT arg_min(acc, k) FROM q), k / (SELECT min(k) FROM q)), 6) AS expected FROM q""",
    "a24_conflicts": T + " SELECT arm, seed, task, h, count(*) AS n, count(DISTINCT target) AS n_targets FROM runs WHERE target IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT target) > 1",
    "a26_first_below": T + KM + " SELECT arm, min(k) AS k FROM per WHERE m < 0.5 GROUP BY 1",
    "a27_label_counts": sql(SQL_NODES) + " " + " UNION ALL ".join(f"SELECT super_class, '{w}' AS what, count({c}) AS n FROM nodes GROUP BY 1" for w, c in (("typed", "cell_type"), ("nt_known", "known_nt"), ("soma", "soma_x"))),
    "a28_directions": "WITH " + DIRS + " SELECT event_type, round(dir, 6) AS direction, round(res, 6) AS resultant, round(wres, 6) AS w_resultant FROM m",
    "a29_synaptic_events": EN + """, o AS (SELECT pre AS id, sum(abs(w)) AS w FROM edges GROUP BY 1), f AS (SELECT post AS id, count(*) AS s FROM edges GROUP BY 1)
        SELECT super_class, CAST(sum(s * w) AS BIGINT) AS events FROM nodes JOIN o USING (id) JOIN f USING (id) GROUP BY 1""",
    "a30_dense_updates": sql(SQL_EDGES) + """, a AS (SELECT np, pre AS id FROM edges WHERE w >= 20 UNION SELECT np, post FROM edges WHERE w >= 20),
        p AS (SELECT e.np, sum(w) AS whole, sum(w) FILTER (x.id IS NOT NULL AND y.id IS NOT NULL) AS between_, count(*) FILTER (w >= 20) AS ticks
              FROM edges e LEFT JOIN a x ON x.np = e.np AND x.id = pre LEFT JOIN a y ON y.np = e.np AND y.id = post WHERE e.np IS NOT NULL GROUP BY 1)
        SELECT np, CAST(CASE WHEN ticks > 0 THEN coalesce(between_, 0) * ticks ELSE whole END AS BIGINT) AS updates FROM p""",
    "g31_checks": EN + """, c AS (SELECT 'weights are positive' AS name, count(*) FILTER (w < 1) AS n FROM edges UNION ALL SELECT 'no self-loops', count(*) FILTER (pre = post) FROM edges
        UNION ALL SELECT 'sources are known', count(*) FROM edges WHERE pre NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'targets are known', count(*) FROM edges WHERE post NOT IN (SELECT id FROM nodes)
        UNION ALL SELECT 'ids are single', count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1)) SELECT name, n, n = 0 AS holds FROM c""",
    "a31_saturation": T + " SELECT arm, count(sat) AS n, round(avg(sat), 6) AS saturation, round(avg(activity), 6) AS activity, count(*) FILTER (sat > 0.5) AS n_saturated FROM runs GROUP BY 1",
    "g18_correlation": sql(SQL_NODES) + """, n AS (SELECT side, atan2(pos_y - 60000.0::DOUBLE, pos_x - 130000.0::DOUBLE) AS a, atan2(soma_y - 60000.0::DOUBLE, soma_x - 130000.0::DOUBLE) AS b FROM nodes
        WHERE pos_x IS NOT NULL AND NOT isnan(pos_x) AND pos_y IS NOT NULL AND NOT isnan(pos_y) AND soma_x IS NOT NULL AND NOT isnan(soma_x) AND soma_y IS NOT NULL AND NOT isnan(soma_y)),
        m AS (SELECT side, atan2(sum(sin(a)), sum(cos(a))) AS p, atan2(sum(sin(b)), sum(cos(b))) AS q, count(*) AS n FROM n GROUP BY 1)
        SELECT n.side, any_value(m.n) AS n, round(sum(sin(a - p) * sin(b - q)) / sqrt(sum(sin(a - p) ** 2) * sum(sin(b - q) ** 2)), 6) AS r FROM n JOIN m ON n.side IS NOT DISTINCT FROM m.side GROUP BY 1""",
    "l15_accepted": T + " SELECT arm, seed FROM runs WHERE acc IS NOT NULL GROUP BY 1, 2 HAVING abs(max(acc) - 1) < 1e-8",
    "t7_queue": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id) AS turn FROM events""",
    "a31_state": sql(SQL_NODES) + """, c AS (SELECT cell_class, count(*) AS n, covar_pop(pos_x, pos_x) AS xx, covar_pop(pos_y, pos_y) AS yy, covar_pop(pos_z, pos_z) AS zz, covar_pop(pos_x, pos_y) AS xy, covar_pop(pos_x, pos_z) AS xz, covar_pop(pos_y, pos_z) AS yz
        FROM nodes WHERE pos_x IS NOT NULL AND pos_y IS NOT NULL AND pos_z IS NOT NULL AND NOT isnan(pos_x) AND NOT isnan(pos_y) AND NOT isnan(pos_z) GROUP BY 1)
        SELECT cell_class, n, round((xx + yy + zz) ** 2 / (xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)), 5) AS participation FROM c WHERE n > 1""",
    "a35_floor": T + " SELECT arm, round(avg(acc), 6) AS mean, max(acc) AS most, round(min(acc - chance), 6) AS margin, count(*) FILTER (acc > chance) AS above FROM runs WHERE acc IS NOT NULL AND chance IS NOT NULL GROUP BY 1",
    "cube_counts": sql(SQL_NODES) + " SELECT flow, side, count(*) AS n FROM nodes WHERE flow IS NOT NULL AND side IS NOT NULL GROUP BY CUBE (flow, side)",
    "w1_top2": sql(SQL_EDGES) + P + ", r AS (SELECT pre, post, w, row_number() OVER (PARTITION BY post ORDER BY w DESC, pre) AS place FROM p) SELECT pre, post, CAST(w AS BIGINT) AS w, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2",
    "w2_argmax": sql(SQL_EDGES) + P + ", r AS (SELECT pre, post, w, row_number() OVER (PARTITION BY post ORDER BY w DESC, pre) AS k FROM p) SELECT post, pre, CAST(w AS BIGINT) AS w FROM r WHERE k = 1",
    "w3_ranks": T + ", r AS (SELECT task, acc, rank() OVER (PARTITION BY task ORDER BY acc) AS r FROM runs WHERE acc IS NOT NULL) SELECT task, acc, count(*) AS n, min(r) + (count(*) - 1) / 2 AS rank FROM r GROUP BY 1, 2",
    "w4_spearman": T + """, v AS (SELECT arm, acc, val FROM runs WHERE acc IS NOT NULL AND val IS NOT NULL), r AS (SELECT arm, acc, val, rank() OVER (PARTITION BY arm ORDER BY acc) AS ra, rank() OVER (PARTITION BY arm ORDER BY val) AS rv FROM v),
        m AS (SELECT arm, ra + (count(*) OVER (PARTITION BY arm, acc) - 1) / 2 AS x, rv + (count(*) OVER (PARTITION BY arm, val) - 1) / 2 AS y FROM r)
        SELECT arm, round(CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END, 6) AS rho FROM m GROUP BY 1""",
    "w5_holm": T + """, q AS (SELECT task, arm, round((1 + count(*) FILTER (acc >= 0.9)) / (1 + count(*)), 9) AS p FROM runs WHERE acc IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY task) - row_number() OVER (PARTITION BY task ORDER BY p, arm) + 1) * p) AS s FROM q)
        SELECT task, arm, p, round(max(s) OVER (PARTITION BY task ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS p_holm FROM s""",
    "w6_gaps": """WITH a AS (SELECT user_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * (2 * pi() / 86400) AS a FROM events), g AS (SELECT user_id, a, lead(a) OVER (PARTITION BY user_id ORDER BY a) - a AS gap FROM a)
        SELECT user_id, count(*) AS n, round(greatest(coalesce(max(gap), 0), min(a) + 2 * pi() - max(a)), 6) AS max_gap FROM g GROUP BY 1""",
    "w7_clusters": "WITH g AS (SELECT user_id, floor(epoch(ts)) - floor(lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts)) AS s FROM events) SELECT user_id, 1 + count(*) FILTER (s > 21600) AS n_clusters FROM g GROUP BY 1",
    "w8_plateau": T + KM + """, i AS (SELECT arm, k, m, row_number() OVER (PARTITION BY arm ORDER BY k) AS i FROM per), o AS (SELECT arm, k, i - row_number() OVER (PARTITION BY arm ORDER BY k) AS g FROM i WHERE m >= 0.4),
        u AS (SELECT arm, min(k) AS first, max(k) AS last, count(*) AS length FROM o GROUP BY arm, g), q AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY length DESC, first) AS z FROM u) SELECT arm, first, last, length FROM q WHERE z = 1""",
    "w9_running": """WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT event_type, day, n, CAST(least(sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1000) AS BIGINT) AS so_far FROM c""",
    "w10_crossings": T + KM + """, q AS (SELECT arm, k AS x0, m - 0.5 AS y0, lead(k) OVER (PARTITION BY arm ORDER BY k) AS x1, lead(m - 0.5) OVER (PARTITION BY arm ORDER BY k) AS y1 FROM per),
        c AS (SELECT arm, (y1 - y0) / (x1 - x0) AS slope, x0 - y0 * (x1 - x0) / (y1 - y0) AS crossing FROM q WHERE y0 < 0 AND y1 >= 0), z AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY slope DESC, crossing) AS z FROM c)
        SELECT arm, round(crossing, 6) AS crossing, round(slope, 6) AS slope FROM z WHERE z = 1""",
    "w12_path": """WITH h AS (SELECT user_id, event_id, sum((value / 100 - 2.5) * 0.1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events)
        SELECT user_id, event_id, round(heading, 5) AS heading, round(sum(cos(heading) * 0.1) OVER w, 5) AS x, round(sum(sin(heading) * 0.1) OVER w, 5) AS y FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "w14_first_reaching": T + ", q AS (SELECT arm, task, k, avg(acc) AS m FROM runs WHERE acc IS NOT NULL GROUP BY 1, 2, 3) SELECT arm, task, min(k) FILTER (m >= 0.45) AS k FROM q GROUP BY 1, 2",
    "w15_stride": sql(SQL_NODES) + ", q AS (SELECT super_class, id, CAST(row_number() OVER (PARTITION BY super_class ORDER BY id) AS INTEGER) AS k FROM nodes) SELECT * FROM q WHERE (k - 1) % 10 = 0",
    "t6_best_setting": T + """, q AS (SELECT arm, task, k, lam, round(avg(acc), 9) AS acc, round(avg(val), 9) AS val FROM runs WHERE acc IS NOT NULL GROUP BY 1, 2, 3, 4),
        z AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY acc DESC, coalesce(-val, 9), coalesce(lam, -1), k, task) AS z FROM q) SELECT arm, round(acc, 6) AS acc, coalesce(lam, -1) AS lam, k, task FROM z WHERE z = 1""",
    "g16_permutation_p": T + """, q AS (SELECT arm, seed, round(avg(acc), 9) AS x FROM runs WHERE acc IS NOT NULL GROUP BY 1, 2), o AS (SELECT arm, max(x) AS obs, avg(x) AS mu, coalesce(stddev_samp(x), 0) AS sd FROM q GROUP BY 1)
        SELECT arm, count(*) AS n, round((1 + count(*) FILTER (abs(x - mu) >= abs(obs - mu) - 1e-12)) / (count(*) + 1), 6) AS p, round(any_value((obs - mu) / nullif(sd, 0)), 6) AS z FROM q JOIN o USING (arm) GROUP BY 1""",
    "g17_welch": T + """, q AS (SELECT arm, count(acc) AS n, avg(acc) AS m, stddev_samp(acc) AS s FROM runs WHERE acc IS NOT NULL GROUP BY 1 HAVING count(acc) > 1), j AS (SELECT a.arm AS arm_a, b.arm AS arm_b, a.m - b.m AS dm, a.s * a.s / a.n AS va, b.s * b.s / b.n AS vb, a.n AS na, b.n AS nb FROM q a JOIN q b ON a.arm < b.arm)
        SELECT arm_a, arm_b, round(dm / nullif(sqrt(va + vb), 0), 5) AS t, round((va + vb) ** 2 / nullif(va * va / (na - 1) + vb * vb / (nb - 1), 0), 3) AS df FROM j""",
    "g18_differences": "WITH " + DIRS + """, q AS (SELECT event_type, round(dir, 6) AS dr FROM m), j AS (SELECT a.event_type AS type_a, b.event_type AS type_b, a.dr - b.dr + pi() AS x FROM q a JOIN q b ON a.event_type < b.event_type)
        SELECT type_a, type_b, round(x - 2 * pi() * floor(x / (2 * pi())) - pi(), 5) AS diff FROM j""",
    "r16_sliding": """WITH s AS (SELECT unnest(range(0, 145)) * 10.0::DOUBLE AS c), e AS (SELECT floor(epoch(ts)) / 60.0 - 28401120.0 AS t, value FROM events)
        SELECT c, count(value) AS n, round(coalesce(sum(value), 0), 6) AS total FROM s LEFT JOIN e ON t >= c - 20 AND t < c + 20 GROUP BY 1""",
    "r17_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, s""",
    "l10_baselines": sql(SQL_NODES) + """, c AS (SELECT super_class, cell_class, count(*) AS n FROM nodes WHERE super_class IS NOT NULL AND cell_class IS NOT NULL GROUP BY 1, 2)
        SELECT super_class, round(max(n) / sum(n), 6) AS majority, count(*) AS n_classes, round(1.0 / count(*), 6) AS chance FROM c GROUP BY 1""",
}
