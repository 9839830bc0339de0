"""Simulations, null models, learning and keyed state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.operators import edges as E
from axonlake.operators import graph_iter as G
from axonlake.operators import readout as L
from axonlake.operators import sample as U
from axonlake.operators import simulate as M
from axonlake.operators import spectral as X
from axonlake.operators.carry import carry_last
from axonlake.plans.views import SQL_EDGES, SQL_NODES, edges, nodes, sql, trials
from axonlake.sources.scratch import materialize
from axonlake.sources.tables import table
from axonlake.streaming import state as R

START = 60.0


def change() -> Column:
    """What an event does to the value of its user."""
    return F.when(F.col("event_type") == "purchase", F.col("value") / 10 - 35.0).otherwise(F.col("value") / 20 - 10.0)


#: Cells of a circuit that is simulated.
CIRCUIT_CELLS = 400


def _circuit(spark: SparkSession, d: str, seeds: str, cells: int = CIRCUIT_CELLS) -> tuple[DataFrame, DataFrame]:
    """The signed connections (pre, post, v) among the first cells downstream of a class, and the cells of that class among them."""
    n, e = nodes(spark, d), edges(spark, d)
    of = n.where(F.col("cell_class") == seeds).select("id")
    got = materialize(G.levels(E.strong(e, 5), of, 2, limit=cells).select("id", "hop"), "circuit")
    return materialize(E.induced(e, got.select("id"), n.select("id", F.col("sign_a").alias("sign")), 5), "circuit-edges"), got.where("hop = 0").select("id")


def _drives(cells: DataFrame, circuit: str, trials: list[tuple[int, float, float, float, float]]) -> DataFrame:
    """A drive of each cell for each (trial, begin_ms, end_ms, level, slope)."""
    rows = F.array(*[F.struct(F.lit(t).alias("trial"), F.lit(a).alias("begin_ms"), F.lit(b).alias("end_ms"), F.lit(x).alias("level"), F.lit(s).alias("slope")) for t, a, b, x, s in trials])
    return cells.select(F.lit(circuit).alias("circuit"), "id", F.explode(rows).alias("d")).select("circuit", "id", "d.*")


def g21_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Spikes per cell in 200 ms of two circuits whose seeds are driven."""
    both, on = [], []
    for seeds in ("Kenyon_Cell", "MBON"):
        e, driven = _circuit(spark, d, seeds)
        both.append(e.withColumn("circuit", F.lit(seeds)))
        on.append(_drives(driven, seeds, [(0, 0.0, 200.0, 25.0, 0.0)]))
    spikes = M.spike_trains(both[0].unionByName(both[1]), on[0].unionByName(on[1]), "circuit")
    return spikes.groupBy("circuit", "id").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("first_ms"))


def a32_protocol(spark: SparkSession, d: str) -> DataFrame:
    """Spikes, active cells and rate in each phase of a schedule: a cue of 60 ms to the left seeds, 40 ms without, a turn of 60 ms to the right ones."""
    e, driven = _circuit(spark, d, "Kenyon_Cell")
    side = driven.join(nodes(spark, d).select("id", "side"), "id")
    on = _drives(side.where("side = 'left'").select("id"), "ring", [(0, 0.0, 60.0, 25.0, 0.0)]).unionByName(_drives(side.where("side = 'right'").select("id"), "ring", [(0, 100.0, 160.0, 25.0, 0.0)]))
    spikes = M.spike_trains(e.withColumn("circuit", F.lit("ring")), on, "circuit", 160.0)
    phase = F.when(F.col("t_ms") < 60, "cue").when(F.col("t_ms") < 100, "hold").otherwise("turn")
    length = F.when(F.col("phase") == "hold", 40.0).otherwise(60.0)
    return spikes.groupBy(phase.alias("phase")).agg(F.count(F.lit(1)).alias("spikes"), F.count_distinct("id").alias("active")).select("phase", "spikes", "active", (F.col("spikes") * 1000 / (F.col("active") * length)).alias("rate_hz"))


def g24_looming(spark: SparkSession, d: str) -> DataFrame:
    """For each speed of a drive that grows with time, when the seeds and the cells behind them fire first."""
    e, driven = _circuit(spark, d, "Kenyon_Cell")
    speeds = [0.1, 0.2, 0.4, 0.8, 1.6]
    spikes = M.spike_trains(e.withColumn("circuit", F.lit("loom")), _drives(driven, "loom", [(i, 0.0, 150.0, 0.0, s) for i, s in enumerate(speeds)]), "circuit", 150.0)
    behind = spikes.join(driven.withColumn("seed", F.lit(True)), "id", "left")
    speed = F.array(*[F.lit(s) for s in speeds])
    return behind.groupBy(F.element_at(speed, F.col("trial") + 1).alias("speed")).agg(F.min(F.when(F.col("seed"), F.col("t_ms"))).alias("first_ms"), F.min(F.when(F.col("seed").isNull(), F.col("t_ms"))).alias("first_behind_ms"), F.count_if(F.col("seed").isNull()).alias("n_behind"))


def g25_steering(spark: SparkSession, d: str) -> DataFrame:
    """Right minus left spikes of the cells behind the seeds, per heading and gain: the seeds of a side are driven the more the further the goal lies on it."""
    e, driven = _circuit(spark, d, "Kenyon_Cell")
    side = nodes(spark, d).select("id", "side")
    seeds = materialize(driven.join(side, "id"), "steering-seeds")
    sweep = [(h, g) for h in (-90, -45, 0, 45, 90) for g in (0.5, 1.0)]
    level = lambda sign: [(i, 0.0, 100.0, max(0.0, 20.0 + sign * g * 10.0 * math.sin(math.radians(h))), 0.0) for i, (h, g) in enumerate(sweep)]
    on = _drives(seeds.where("side = 'right'").select("id"), "steer", level(1)).unionByName(_drives(seeds.where("side = 'left'").select("id"), "steer", level(-1)))
    spikes = M.spike_trains(e.withColumn("circuit", F.lit("steer")), on, "circuit", 100.0).join(seeds.select("id"), "id", "left_anti").join(side, "id")
    table_ = spark.createDataFrame([(i, h, g) for i, (h, g) in enumerate(sweep)], "trial int, heading int, gain double")
    turned = spikes.groupBy("trial").agg((F.count_if(F.col("side") == "right") - F.count_if(F.col("side") == "left")).alias("turn"))
    return table_.join(turned, "trial", "left").select("heading", "gain", F.coalesce("turn", F.lit(0)).alias("turn"))


def class_matrix(spark: SparkSession, d: str) -> DataFrame:
    """(pre, post, v): synapses between cell classes; as many rows as there are pairs of classes."""
    n = nodes(spark, d).where("cell_class IS NOT NULL").select("id", "cell_class")
    e = edges(spark, d).groupBy("pre", "post").agg(F.sum("w").alias("w"))
    e = e.join(n.withColumnsRenamed({"id": "pre", "cell_class": "a"}), "pre").join(n.withColumnsRenamed({"id": "post", "cell_class": "b"}), "post")
    return e.groupBy(F.col("a").alias("pre"), F.col("b").alias("post")).agg((F.sum("w") / 1000.0).alias("v"))


def g7_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """The sums of the eigenvalues of the class matrix and of their squares, and how many there are."""
    x = X.eigenvalues(class_matrix(spark, d))
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("re"), 6).alias("total"), F.round(F.sum(F.col("re") * F.col("re") - F.col("im") * F.col("im")), 4).alias("squares"))


def g7_slow_modes(spark: SparkSession, d: str) -> DataFrame:
    """Radius, largest real part and number of slow modes of the 50 largest eigenvalues."""
    x = X.eigenvalues(class_matrix(spark, d), 50).withColumn("size", F.hypot("re", "im"))
    radius = x.agg(F.max("size").alias("radius"))  # one row
    return x.crossJoin(F.broadcast(radius)).groupBy("radius").agg(F.max("re").alias("largest_re"), F.count_if(F.col("size") >= 0.9 * F.col("radius")).alias("slow_modes"))


def g8_laplacian(spark: SparkSession, d: str) -> DataFrame:
    """Sum and sum of squares of the Laplacian's eigenvalues, and the length of all its vectors, which is their number."""
    x = X.laplacian(class_matrix(spark, d))
    values = x.groupBy("place").agg(F.first("value").alias("v"), F.sum(F.col("x") * F.col("x")).alias("l"))
    return values.agg(F.round(F.sum("l"), 6).alias("n"), F.round(F.sum("v") / 1e3, 4).alias("total"), F.round(F.sum(F.col("v") * F.col("v")) / 1e6, 2).alias("squares"))


def g9_clusters(spark: SparkSession, d: str) -> DataFrame:
    return X.spectral_clusters(class_matrix(spark, d), 2, 20, seed=4)


def g20_separability(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the class matrix, and whether a plane tells classes that mostly excite from those that mostly inhibit."""
    signs = nodes(spark, d).where("cell_class IS NOT NULL").groupBy("cell_class").agg(F.sum("sign_a").alias("s")).collect()  # one row per class
    return X.separability(class_matrix(spark, d), {r["cell_class"]: 1 if r["s"] >= 0 else -1 for r in signs})


AXES = ["pos_x", "pos_y", "pos_z"]


def g10_plane(spark: SparkSession, d: str) -> DataFrame:
    """The variance of all cells' positions along their principal axes together, which is that along x, y and z."""
    n = nodes(spark, d).where(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in AXES))
    c = X.in_plane(n, AXES, 3)
    got = n.select(*[c[f"place_{k}"].alias(f"p{k}") for k in (1, 2, 3)])
    return got.agg(F.count(F.lit(1)).alias("n"), F.round(sum((F.var_pop(f"p{k}") for k in (1, 2, 3)), F.lit(0.0)) / 1e6, 3).alias("variance"))


def g11_residual(spark: SparkSession, d: str) -> DataFrame:
    """How far cells lie from the plane of all positions, by side."""
    n = nodes(spark, d).where(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in AXES))
    return n.select("side", X.in_plane(n, AXES)["residual"].alias("r")).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 9).alias("mean_residual"))


def g19_matched_null(spark: SparkSession, d: str) -> DataFrame:
    """The moments of three normal samples matched to the cells' positions, which are those of the positions."""
    got = X.matched_null(nodes(spark, d), AXES, 3, seed=2)
    return got.groupBy(F.col("sample").cast("long").alias("sample")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pos_x"), 3).alias("mean_x"), F.round(F.covar_pop("pos_x", "pos_y") / 1e6, 3).alias("xy"), F.round(F.var_pop("pos_z") / 1e6, 3).alias("zz"))


def g14_dealt(spark: SparkSession, d: str) -> DataFrame:
    """How often each weight occurs after the weights of all pairs were dealt anew, as before, and the balance of signs."""
    p = E.pairs(edges(spark, d)).select("pre", "post", "w")
    dealt = M.dealt_anew(p, "w", seed=6).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return dealt.unionByName(M.balanced_signs(p, "w", seed=6).select(F.signum("w").cast("long").alias("w")).groupBy("w").agg((-F.count(F.lit(1))).alias("n")))


def g12_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of partners in four rewired copies of one class's subgraph, which must be those of the subgraph itself."""
    ids = nodes(spark, d).where("cell_class = 'Kenyon_Cell'").select("id")
    p = E.pairs(E.slice_between(edges(spark, d), ids, ids)).where("pre != post")
    r = M.rewired(p, 4, seed=5)
    roles = r.select("sample", F.col("pre").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(r.select("sample", "post", F.lit(0), F.lit(1)))
    return roles.groupBy("sample", "id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def g13_random_graphs(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs and self-loops three random graphs of 500 nodes and 4,000 edges have."""
    r = M.random_graphs(spark, 500, 4000, 3, seed=9)
    return r.groupBy("sample").agg(F.count_distinct("pre", "post").alias("pairs"), F.count_if(F.col("pre") == F.col("post")).alias("loops"))


def g15_null(spark: SparkSession, d: str) -> DataFrame:
    """Two arms' difference of mean accuracy against 1,000 deals of their labels."""
    t = trials(spark, d)
    null = M.permuted_differences(t, "arm", "acc", "mb_wired", "cx_wired", 1000, seed=3)
    obs = t.where("acc IS NOT NULL").agg((F.avg(F.when(F.col("arm") == "mb_wired", F.col("acc"))) - F.avg(F.when(F.col("arm") == "cx_wired", F.col("acc")))).alias("obs"))
    mean = null.agg(F.avg("diff").alias("mean"))  # one row each
    rows = null.crossJoin(obs).crossJoin(mean)
    return rows.groupBy("obs", "mean").agg(((1 + F.count_if(F.abs(F.col("diff") - F.col("mean")) >= F.abs(F.col("obs") - F.col("mean")))) / (F.count(F.lit(1)) + 1)).alias("p"))


def g15_stratified(spark: SparkSession, d: str) -> DataFrame:
    """The same with labels dealt anew within each task; what is dealt keeps the number of labels, so the deals' weighted means add up to the mean of all."""
    t = trials(spark, d)
    null = M.permuted_differences(t, "arm", "acc", "mb_wired", "cx_wired", 500, seed=3, stratum="task")
    return null.agg(F.count(F.lit(1)).alias("samples"), F.avg("diff").alias("mean"), F.stddev("diff").alias("sd"))


def g22_memory(spark: SparkSession, d: str) -> DataFrame:
    """Memory of the circuit behind the Kenyon cells."""
    e, _ = _circuit(spark, d, "Kenyon_Cell")
    return M.memory_grid(e, 3, [2, 4, 6])


def r2_vitals(spark: SparkSession, d: str) -> DataFrame:
    """Each user's clamped value after all events, replayed day by day."""
    got = R.clamped_fold(table(spark, d, "events"), "user_id", "ts", "event_id", change(), START, F.to_date("ts"))
    return got.select("user_id", F.round("value", 6).alias("value"), "n")


def r2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Each user's energy, hunger and boredom after all events, which change with the time between them: a step is 0.05 to 5 seconds, and boredom grows only where 45 seconds or more were idle."""
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ev = carry_last(ev, ["user_id"], "us", ["event_id"], F.col("us"), "before", 86_400_000_000)
    gap = (F.col("us") - F.col("before")) / 1e6
    ev = materialize(ev.select("user_id", "ts", "event_id", F.when(gap.isNotNull(), F.greatest(F.lit(0.05), F.least(F.lit(5.0), gap))).otherwise(0.0).alias("dt"), F.coalesce(gap >= 45, F.lit(False)).alias("idle")), "rates")
    fold = lambda rate, start, name: R.clamped_fold(ev, "user_id", "ts", "event_id", rate, start, F.to_date("ts")).select("user_id", F.round("value", 6).alias(name))
    v = fold(-0.30 * F.col("dt"), 80.0, "energy").join(fold(0.45 * F.col("dt"), 20.0, "hunger"), "user_id")
    return v.join(fold(F.when(F.col("idle"), 0.60 * F.col("dt")), 10.0, "boredom"), "user_id")


def r7_rest(spark: SparkSession, d: str) -> DataFrame:
    """Each user's energy and rest episodes when every event is a tick of 5 seconds."""
    ev = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id", F.lit(5.0).alias("dt"))
    return R.rest_episodes(ev, "user_id", "t", "event_id", "dt").select("user_id", F.round("energy", 6).alias("energy"), "episodes")


UNITS = 512


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """(word, units, label): type names with their most frequent class."""
    n = nodes(spark, d).where("cell_type IS NOT NULL AND cell_class IS NOT NULL").groupBy("cell_type", "cell_class").agg(F.count(F.lit(1)).alias("n"))
    label = n.groupBy(F.col("cell_type").alias("word")).agg(F.max_by("cell_class", F.struct("n", "cell_class")).alias("label"))
    return materialize(L.coded(n, "cell_type", UNITS, 7).join(label, "word"), "vocabulary")


def l5_trained(spark: SparkSession, d: str) -> DataFrame:
    """What a readout of hashed n-grams makes of the vocabulary, by class: words and how many it tells."""
    v = _vocabulary(spark, d)
    got = L.measured(L.fitted(v, UNITS), v).join(v.select("word", F.col("label").alias("truth")), "word")
    return got.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("truth")).alias("n_right"), F.round(F.min("confidence"), 6).alias("least"))


def l2_lesson(spark: SparkSession, d: str) -> DataFrame:
    """What teaching one new word under a new label does to the vocabulary, and that taking it back leaves nothing."""
    v = _vocabulary(spark, d)
    first = L.fitted(v, UNITS)
    word = L.coded(spark.createDataFrame([("sugarcane",)], "w string"), "w", UNITS, 7)
    second, steps = L.taught(first, [int(u) for u in word.first()["units"]], "taught")
    before = materialize(L.measured(first, v), "before-lesson")
    label = L.measured(second, word).first()["label"]
    told = L.lesson_effects(before, L.measured(second, v), 0.5, 0.1)
    undone = L.lesson_effects(before, L.measured(first, v), 0.5, 0.0).select(F.col("n_changed").alias("n_changed_after_undo"))
    return told.crossJoin(undone).select("*", F.lit(label).alias("label"), F.lit(steps).alias("steps"))  # one row each


def a36_measured(spark: SparkSession, d: str) -> DataFrame:
    """The readout's label, confidence and margin for every type name."""
    v = _vocabulary(spark, d)
    return L.measured(L.fitted(v, UNITS), v).select("word", "label", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"))


def u6_draws(spark: SparkSession, d: str) -> DataFrame:
    """30 draws of places, with replacement."""
    return U.with_replacement(edges(spark, d).where("np IS NOT NULL"), "np", 30, seed=11)


def u5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """40 tasks of two numbers of two digits whose difference borrows."""
    n = spark.range(10, 100).select(F.col("id").cast("int").alias("a"))
    return U.accepted(n.crossJoin(n.withColumnRenamed("a", "b")), "a > b AND a % 10 < b % 10", ["a", "b"], 40, seed=12)  # 8,100 tasks


def r8_environment(spark: SparkSession, d: str) -> DataFrame:
    """The events after 45 idle seconds that chance picks, one in twenty, at most one in 90 minutes per user."""
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ev = carry_last(ev, ["user_id"], "us", ["event_id"], F.col("us"), "before", 86_400_000_000)
    lucky = F.pmod(F.col("event_id") * F.lit(2654435761), F.lit(4294967296)) < F.lit(4294967296 // 20)
    return R.throttled(ev.where((F.col("us") - F.col("before") >= 45_000_000) & lucky).select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 90 * 60)


PHRASES = {  # fixed values: answers by kind of event
    "purchase": ["that tasted good", "more, please"], "click": ["hello", "who is there", "buzz"], "view": ["I see you"],
}


def r13_phrases(spark: SparkSession, d: str) -> DataFrame:
    """How often each answer is given when the answers of a kind take turns by event; kinds without answers get none."""
    known = spark.createDataFrame([(k, v) for k, v in PHRASES.items()], "event_type string, said array<string>")
    got = table(spark, d, "events").join(F.broadcast(known), "event_type", "left").select("event_type", F.get("said", F.pmod("event_id", F.size("said")).cast("int")).alias("phrase"))
    return got.groupBy("event_type", "phrase").agg(F.count(F.lit(1)).alias("n"))


def r14_commands(spark: SparkSession, d: str) -> DataFrame:
    """The teach commands in all texts, by verb, word and category."""
    pattern = r"(?m)(?:^|: )(teach|öğret|undo|list)(?:: *([^\n=]+?) *= *([^\n=]+?))? *$"
    hit = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("c"))
    part = lambda i: F.regexp_extract("c", pattern, i)
    return hit.select(part(1).alias("verb"), part(2).alias("word"), part(3).alias("category")).groupBy("verb", "word", "category").agg(F.count(F.lit(1)).alias("n"))


def r2_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by the streaming operator."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{d}/events*.parquet")
    rows = stream.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", change().alias("delta"))
    out = R.drained(R.stream_vitals(rows, "user_id", "ts", "event_id", START), "vitals")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("value", "n"), "n").alias("s"))
    return last.select("user_id", F.round("s.value", 6).alias("value"), "s.n")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def r4_flags(spark: SparkSession, d: str) -> DataFrame:
    """Which users' event kinds were seen within two hours before the end of January 29th."""
    now = F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    ev = table(spark, d, "events").where(F.col("ts") <= now)
    return R.live_flags(ev, "user_id", "event_type", "ts", 7200, now)


def r5_moods(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    fold = lambda kind, name: R.clamped_fold(ev, "user_id", "ts", "event_id", F.when(F.col("event_type") == kind, F.col("value") / 5 - 40.0), 50.0, F.to_date("ts")).select("user_id", F.col("value").alias(name))
    v = fold("click", "energy").join(fold("view", "hunger"), "user_id").join(fold("purchase", "boredom"), "user_id")
    return v.groupBy(R.mood(F.col("energy"), F.col("hunger"), F.col("boredom")).alias("mood")).agg(F.count(F.lit(1)).alias("n"))


def r6_throttled(spark: SparkSession, d: str) -> DataFrame:
    """Purchases that fire an answer, at most one in twelve hours per user."""
    ev = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return R.throttled(ev, "user_id", "ts", "event_id", 12 * 3600)


QUERIES = {f.__name__: f for f in (a32_protocol, g7_spectrum, g7_slow_modes, g8_laplacian, g9_clusters, g10_plane, g11_residual, g14_dealt, g15_stratified, g19_matched_null, g20_separability, g24_looming, g25_steering, g12_degrees, g13_random_graphs, g15_null, g21_spikes, g22_memory, a36_measured, u5_pairs, u6_draws, r8_environment, r13_phrases, l2_lesson, l5_trained, r7_rest, r14_commands, r2_rates, r2_vitals, r2_stream, r4_flags, r5_moods, r6_throttled)}

_FOLD = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_type = 'purchase' THEN value / 10 - 35 ELSE value / 20 - 10 END AS dv FROM events),
    f AS (SELECT user_id, i, least(100.0::DOUBLE, greatest(0.0::DOUBLE, 60 + dv)) AS v FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, least(100.0::DOUBLE, greatest(0.0::DOUBLE, v + dv)) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, round(arg_max(v, i), 6) AS value, count(*) AS n FROM f GROUP BY 1"""
_CLASSES = """, cm AS (SELECT a.cell_class AS pre, b.cell_class AS post, sum(w) / 1000.0 AS v FROM edges JOIN nodes a ON pre = a.id JOIN nodes b ON post = b.id WHERE a.cell_class IS NOT NULL AND b.cell_class IS NOT NULL GROUP BY ALL),
    ids AS (SELECT pre AS id FROM cm UNION SELECT post FROM cm)"""
_WHOLE = "pos_x IS NOT NULL AND NOT isnan(pos_x) AND pos_y IS NOT NULL AND NOT isnan(pos_y) AND pos_z IS NOT NULL AND NOT isnan(pos_z)"
SQL = {
    "g7_spectrum": sql(SQL_EDGES, SQL_NODES) + _CLASSES + """ SELECT (SELECT count(*) FROM ids) AS n, round((SELECT sum(v) FROM cm WHERE pre = post), 6) AS total,
        round((SELECT sum(a.v * b.v) FROM cm a JOIN cm b ON a.pre = b.post AND a.post = b.pre), 4) AS squares""",
    "g8_laplacian": sql(SQL_EDGES, SQL_NODES) + _CLASSES + """, s AS (SELECT a.post AS i, b.post AS j, sum(a.v * b.v) AS s FROM cm a JOIN cm b ON a.pre = b.pre WHERE a.post <> b.post GROUP BY ALL),
        deg AS (SELECT i, sum(s) AS d FROM s GROUP BY 1)
        SELECT round(CAST((SELECT count(*) FROM ids) AS DOUBLE), 6) AS n, round((SELECT sum(d) FROM deg) / 1e3, 4) AS total, round(((SELECT sum(d * d) FROM deg) + (SELECT sum(s * s) FROM s)) / 1e6, 2) AS squares""",
    "g10_plane": sql(SQL_NODES) + f" SELECT count(*) AS n, round((var_pop(pos_x) + var_pop(pos_y) + var_pop(pos_z)) / 1e6, 3) AS variance FROM nodes WHERE {_WHOLE}",
    "g14_dealt": sql(SQL_EDGES) + """, p AS (SELECT pre, post, CAST(sum(w) AS BIGINT) AS w FROM edges GROUP BY 1, 2) SELECT w, count(*) AS n FROM p GROUP BY 1
        UNION ALL SELECT unnest([1, -1]) AS w, unnest([-((count(*) + 1) // 2), -(count(*) // 2)]) AS n FROM p""",
    "g19_matched_null": sql(SQL_NODES) + f""", m AS (SELECT count(*) AS n, round(avg(pos_x), 3) AS mean_x, round(covar_pop(pos_x, pos_y) / 1e6, 3) AS xy, round(var_pop(pos_z) / 1e6, 3) AS zz FROM nodes WHERE {_WHOLE})
        SELECT sample, m.* FROM m, (SELECT unnest(range(3)) AS sample)""",
    "g12_degrees": sql(SQL_EDGES, SQL_NODES) + """, k AS (SELECT id FROM nodes WHERE cell_class = 'Kenyon_Cell'), p AS (SELECT DISTINCT pre, post FROM edges WHERE pre <> post AND pre IN (SELECT id FROM k) AND post IN (SELECT id FROM k)),
        r AS (SELECT pre AS id, 1 AS o, 0 AS i FROM p UNION ALL SELECT post, 0, 1 FROM p)
        SELECT sample, id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM r, (SELECT unnest(range(4)) AS sample) GROUP BY 1, 2""",
    "g13_random_graphs": "SELECT unnest(range(3)) AS sample, CAST(4000 AS BIGINT) AS pairs, CAST(0 AS BIGINT) AS loops",
    "r2_vitals": _FOLD,
    "r2_stream": _FOLD,
    "r2_rates": """WITH RECURSIVE g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS us FROM events),
        e AS (SELECT user_id, i, coalesce(greatest(0.05::DOUBLE, least(5.0::DOUBLE, us / 1e6)), 0) AS dt, coalesce(us >= 45e6, false) AS idle FROM g),
        f AS (SELECT user_id, i, 80.0::DOUBLE AS en, 20.0::DOUBLE AS hu, 10.0::DOUBLE AS bo FROM e WHERE i = 1
              UNION ALL SELECT e.user_id, e.i, least(100.0::DOUBLE, greatest(0.0::DOUBLE, en - 0.30 * dt)), least(100.0::DOUBLE, greatest(0.0::DOUBLE, hu + 0.45 * dt)), least(100.0::DOUBLE, greatest(0.0::DOUBLE, bo + CASE WHEN idle THEN 0.60 * dt ELSE 0 END))
              FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
        SELECT user_id, round(arg_max(en, i), 6) AS energy, round(arg_max(hu, i), 6) AS hunger, round(arg_max(bo, i), 6) AS boredom FROM f GROUP BY 1""",
    "r8_environment": """WITH RECURSIVE g AS (SELECT user_id, ts, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
        e AS (SELECT user_id, ts, event_id FROM g WHERE gap >= 45000000 AND (CAST(event_id AS HUGEINT) * 2654435761) % 4294967296 < 214748364),
        f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM e GROUP BY 1
              UNION ALL SELECT e.user_id, arg_min(e.event_id, (e.ts, e.event_id)), min(e.ts) FROM f JOIN e ON e.user_id = f.user_id AND e.ts >= f.ts + INTERVAL 90 MINUTES GROUP BY e.user_id)
        SELECT user_id, ts, event_id FROM f""",
    "r13_phrases": "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v!r}::VARCHAR[])" for k, v in PHRASES.items()) + """) AS p(event_type, said))
        SELECT e.event_type, said[event_id % len(said) + 1] AS phrase, count(*) AS n FROM events e LEFT JOIN p ON p.event_type = e.event_type GROUP BY 1, 2""",
    "r7_rest": """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) / 1e6 AS t FROM events),
        f AS (SELECT DISTINCT user_id, 0 AS i, 60.0::DOUBLE AS en, 0 AS lef, -1e18::DOUBLE AS began, 0 AS ep FROM events
              UNION ALL SELECT e.user_id, e.i, CASE WHEN lef > 0 THEN least(100.0::DOUBLE, greatest(0.0::DOUBLE, en - 1.5) + 3) ELSE greatest(0.0::DOUBLE, en - 1.5) END,
                CASE WHEN lef > 0 THEN lef - 1 WHEN greatest(0.0::DOUBLE, en - 1.5) <= 30 AND t - began >= 60 THEN 10 ELSE 0 END,
                CASE WHEN lef = 0 AND greatest(0.0::DOUBLE, en - 1.5) <= 30 AND t - began >= 60 THEN t ELSE began END,
                ep + CASE WHEN lef = 0 AND greatest(0.0::DOUBLE, en - 1.5) <= 30 AND t - began >= 60 THEN 1 ELSE 0 END
              FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
        SELECT user_id, round(arg_max(en, i), 6) AS energy, CAST(max(ep) AS BIGINT) AS episodes FROM f GROUP BY 1""",
    "r14_commands": r"""WITH c AS (SELECT unnest(regexp_extract_all(lower(replace(text, chr(13), '')), '(?m)(?:^|: )(teach|öğret|undo|list)(?:: *([^\n=]+?) *= *([^\n=]+?))? *$')) AS c FROM documents),
        p AS (SELECT regexp_extract(c, '(teach|öğret|undo|list)', 1) AS verb, CASE WHEN contains(c, '=') THEN trim(regexp_extract(c, '(?:teach|öğret|undo|list): *([^=]*)=', 1)) ELSE '' END AS word, CASE WHEN contains(c, '=') THEN trim(split_part(c, '=', 2)) ELSE '' END AS category FROM c)
        SELECT verb, word, category, count(*) AS n FROM p GROUP BY ALL""",
    "r5_moods": """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type AS k, value / 5 - 40 AS dv FROM events),
        s AS (SELECT DISTINCT user_id, 0 AS i, 50.0::DOUBLE AS en, 50.0::DOUBLE AS hu, 50.0::DOUBLE AS bo FROM events),
        f AS (SELECT * FROM s UNION ALL SELECT e.user_id, e.i, least(100.0::DOUBLE, greatest(0.0::DOUBLE, en + CASE WHEN k = 'click' THEN dv ELSE 0 END)), least(100.0::DOUBLE, greatest(0.0::DOUBLE, hu + CASE WHEN k = 'view' THEN dv ELSE 0 END)),
              least(100.0::DOUBLE, greatest(0.0::DOUBLE, bo + CASE WHEN k = 'purchase' THEN dv ELSE 0 END)) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1),
        l AS (SELECT user_id, arg_max(en, i) AS en, arg_max(hu, i) AS hu, arg_max(bo, i) AS bo FROM f GROUP BY 1)
        SELECT CASE WHEN hu >= 70 THEN 'hungry' WHEN en <= 25 THEN 'tired' WHEN bo >= 70 THEN 'bored' WHEN en >= 80 AND hu <= 25 THEN 'cheerful' ELSE 'calm' END AS mood, count(*) AS n FROM l GROUP BY 1""",
    "r4_flags": """SELECT user_id, event_type, max(ts) + INTERVAL 2 HOURS AS expires FROM events WHERE ts <= TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1, 2 HAVING max(ts) + INTERVAL 2 HOURS > TIMESTAMP '2024-01-29 00:00:00'""",
    "r6_throttled": """WITH RECURSIVE e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
        f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM e GROUP BY 1
              UNION ALL SELECT e.user_id, arg_min(e.event_id, (e.ts, e.event_id)), min(e.ts) FROM f JOIN e ON e.user_id = f.user_id AND e.ts >= f.ts + INTERVAL 12 HOURS GROUP BY e.user_id)
        SELECT user_id, ts, event_id FROM f""",
}
