"""Search, routing, rules, interpolation, phases, encoders, gates and grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.functions.cells import any_contains
from axonlake.functions.text import ngrams
from axonlake.operators import codes as C
from axonlake.operators import edges as E
from axonlake.operators.simulate import Drive, Membrane, Wiring
from axonlake.plans.graph_rows import j6_opposed
from axonlake.plans.graph_search import j14_overlaps
from axonlake.plans.views import SQL_EDGES, SQL_NODES, SQL_TRIALS, edges, nodes, sql, trials
from axonlake.sources.tables import table

r6 = lambda c, name: F.round(c, 6).alias(name)

#: What a search word stands for.
ALIASES = {"mushroom body": ["kenyon", "mbon"], "compass": ["ring", "wedge"], "smell": ["pn", "lhln"]}
SEARCHES = ["the mushroom body", "compass", "smell and compass", "optic"]
PHASES = [("cue", "2024-01-01", "2024-01-11"), ("hold", "2024-01-11", "2024-01-21"), ("turn", "2024-01-21", "2024-02-01")]
EFFECTS = {"purchase": (-35.0, 8.0), "click": (-5.0, 0.5), "view": (1.0, -1.0)}


def g3_find(spark: SparkSession, d: str) -> DataFrame:
    """For each search: how many cells match, and the first 15 of them by id. A search that holds alias words stands for their terms."""
    terms = [(q, t) for q in SEARCHES for t in ([t for k, ts in ALIASES.items() if k in q for t in ts] or [q])]
    wanted = spark.createDataFrame(terms, "search string, term string")  # a few rows
    cells = nodes(spark, d).select("id", F.lower(F.concat_ws("\x01", "cell_type", "cell_class", "super_class", "synonyms")).alias("text"))
    hits = cells.join(F.broadcast(wanted), F.col("text").contains(F.col("term"))).select("search", "id").distinct()
    total = hits.groupBy("search").agg(F.count(F.lit(1)).alias("n_matches"))
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy("search").orderBy("id"))).where("k <= 15")
    return first.join(total, "search").select("search", "n_matches", "id")


def g30_modes(spark: SparkSession, d: str) -> DataFrame:
    """The class most inputs of a cell come from, the first by name on ties."""
    cls = nodes(spark, d).where("cell_class IS NOT NULL").select(F.col("id").alias("pre"), "cell_class")
    n = edges(spark, d).join(cls, "pre").groupBy("post", "cell_class").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("post").agg(F.max("n").alias("n"))
    return n.join(top, ["post", "n"]).groupBy("post", "n").agg(F.min("cell_class").alias("cell_class"))


def g26_raster(spark: SparkSession, d: str) -> DataFrame:
    """Cells on a 22 by 22 grid over the volume, the largest input weight of each bin."""
    w = edges(spark, d).groupBy("post").agg(F.sum("w").alias("w"))
    n = nodes(spark, d).where("pos_x BETWEEN 20000 AND 250000 AND pos_y BETWEEN 0 AND 150000").select(F.col("id").alias("post"), "pos_x", "pos_y")
    bin_of = lambda c, lo, hi: F.least(F.lit(21), F.floor((F.col(c) - lo) / (hi - lo) * 22)).cast("int")
    return n.join(w, "post").groupBy(bin_of("pos_x", 20000.0, 250000.0).alias("gx"), bin_of("pos_y", 0.0, 150000.0).alias("gy")).agg(F.max("w").alias("w"))


def w11_interpolated(spark: SparkSession, d: str) -> DataFrame:
    """Each user's value at the noons between two of the user's events, on the line between them."""
    ev = table(spark, d, "events").groupBy("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).agg(F.avg("value").alias("v"))
    nxt = Window.partitionBy("user_id").orderBy("s")
    spans = ev.select("user_id", F.col("s").alias("s0"), F.col("v").alias("v0"), F.lead("s").over(nxt).alias("s1"), F.lead("v").over(nxt).alias("v1")).where("s1 IS NOT NULL")
    first, last = F.ceil((F.col("s0") - 43200) / 86400), F.ceil((F.col("s1") - 43200) / 86400) - 1  # noons in [s0, s1)
    days = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    at = F.col("day") * 86400 + 43200
    return spans.withColumn("day", F.explode(days)).select("user_id", "day", r6(F.col("v0") + (F.col("v1") - F.col("v0")) * (at - F.col("s0")) / (F.col("s1") - F.col("s0")), "value"))


def j12_phases(spark: SparkSession, d: str) -> DataFrame:
    """Counts and totals of events by the phase they fall in, half-open."""
    phases = spark.createDataFrame(PHASES, "phase string, lo string, hi string").select("phase", F.col("lo").cast("timestamp_ntz").alias("lo"), F.col("hi").cast("timestamp_ntz").alias("hi"))
    ev = table(spark, d, "events")
    return ev.join(F.broadcast(phases), (F.col("ts") >= F.col("lo")) & (F.col("ts") < F.col("hi"))).groupBy("phase", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def r10_effects(spark: SparkSession, d: str) -> DataFrame:
    """What a rule table makes of each user's events; kinds without a rule do nothing."""
    rules = spark.createDataFrame([(k, h, e) for k, (h, e) in EFFECTS.items()], "event_type string, hunger double, energy double")
    got = table(spark, d, "events").join(F.broadcast(rules), "event_type", "left")
    return got.groupBy("user_id").agg(r6(F.coalesce(F.sum("hunger"), F.lit(0.0)), "hunger"), r6(F.coalesce(F.sum("energy"), F.lit(0.0)), "energy"), F.count_if(F.col("hunger").isNull()).alias("n_without_rule"))


def r12_routes(spark: SparkSession, d: str) -> DataFrame:
    """Which way each text goes: a teach command, arithmetic, a word of food or danger, or none, in this order."""
    t = F.lower("text")
    route = (
        F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty").when(t.rlike(r"(^|\n|: )(teach|öğret): "), "teach").when(t.rlike(r"\d+ [-+*/] \d+"), "arithmetic")
        .when(t.rlike("sugar|şeker|zucker|azúcar"), "food").when(t.contains("swat"), "danger").otherwise("unknown")
    )
    return table(spark, d, "documents").groupBy(route.alias("route"), F.lower("lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def l5_scores(spark: SparkSession, d: str) -> DataFrame:
    """Type names scored for each class by how their trigrams are shared out among classes; the class of the highest score with its softmax share."""
    names = nodes(spark, d).where("cell_type IS NOT NULL AND cell_class IS NOT NULL").groupBy("cell_type", "cell_class").agg(F.count(F.lit(1)).alias("n"))
    grams = names.select("cell_type", "cell_class", "n", F.explode(F.array_distinct(ngrams(F.lower("cell_type"), 3))).alias("g"))
    share = grams.groupBy("g", "cell_class").agg(F.sum("n").alias("n"))
    total = share.groupBy("g").agg(F.sum("n").alias("t"))
    weights = share.join(total, "g").select("g", F.col("cell_class").alias("cls"), (F.col("n") / F.col("t")).alias("w"))
    scores = grams.select("cell_type", "g").distinct().join(weights, "g").groupBy("cell_type", "cls").agg(F.round(F.sum("w"), 9).alias("z"))
    top = scores.groupBy("cell_type").agg(F.max("z").alias("top"))
    soft = scores.join(top, "cell_type").groupBy("cell_type").agg(F.min(F.when(F.col("z") == F.col("top"), F.col("cls"))).alias("cls"), r6(1 / F.sum(F.exp((F.col("z") - F.col("top")) / 0.4)), "confidence"))
    return soft


def a25_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """How often the scored class is the most frequent one of a name, and how sure it is."""
    n = nodes(spark, d).where("cell_type IS NOT NULL AND cell_class IS NOT NULL").groupBy("cell_type", "cell_class").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("cell_type").agg(F.max("n").alias("n"))
    truth = n.join(top, ["cell_type", "n"]).groupBy("cell_type").agg(F.min("cell_class").alias("truth"))
    got = l5_scores(spark, d).join(truth, "cell_type")
    return got.agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("cls") == F.col("truth")).cast("int")), "accuracy"), F.min("confidence").alias("least"), F.round(F.avg("confidence"), 5).alias("mean"))


def l8_gauss_codes(spark: SparkSession, d: str) -> DataFrame:
    """Tuning curves of 20 units over the numbers 1 to 9, and a thermometer code beside them."""
    n = spark.range(1, 10).select(F.col("id").cast("int").alias("n")).crossJoin(spark.range(20).select(F.col("id").cast("int").alias("unit")))
    centre = 1 + F.col("unit") * (8.0 / 19.0)
    return n.select("n", "unit", r6(F.exp(-F.pow(F.col("n") - centre, 2) / (2 * 0.8 * 0.8)), "code"), (F.col("unit") < F.col("n") * 2).cast("int").alias("thermo"))


def a34_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Spread of the overlaps of places, and of each place's best."""
    o = j14_overlaps(spark, d)
    each = o.select(F.col("a").alias("p"), "jaccard").unionAll(o.select("b", "jaccard")).groupBy("p").agg(F.max("jaccard").alias("best"))
    q = lambda c, p: F.round(F.expr(f"percentile({c}, {p})"), 6)
    one = o.agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg("jaccard"), "mean"), q("jaccard", 0.5).alias("median"), q("jaccard", 0.95).alias("p95"), F.max("jaccard").alias("most"))
    return one.crossJoin(each.agg(r6(F.avg("best"), "mean_best"), F.min("best").alias("least_best")))  # one row each


def a33_danger(spark: SparkSession, d: str) -> DataFrame:
    """How much of each place's code lies in the union of the codes of the three largest places."""
    w = edges(spark, d).where("np IS NOT NULL").groupBy("np", "post").agg(F.sum("w").alias("w"))
    code = C.winners(w, ["np"], "w", 30).select("np", "post")
    big = w.groupBy("np").agg(F.sum("w").alias("w")).orderBy(F.desc("w"), "np").limit(3).select("np")
    bad = code.join(big, "np", "left_semi").select("post").distinct().withColumn("bad", F.lit(1))
    return code.join(bad, "post", "left").groupBy("np").agg(F.count(F.lit(1)).alias("n"), r6(F.count("bad") / F.count(F.lit(1)), "danger"))


def u7_grid(spark: SparkSession, d: str) -> DataFrame:
    """All settings of arm, task and k, with the number of trials each has, also none."""
    t = trials(spark, d)
    one = lambda c: t.select(c).distinct()
    grid = one("arm").crossJoin(F.broadcast(one("task"))).crossJoin(F.broadcast(one("k")))  # names of arms, tasks and lengths: a few hundred settings
    done = t.groupBy("arm", "task", "k").agg(F.count(F.lit(1)).alias("n"))
    g, n = grid.alias("g"), done.alias("n")
    same = F.col("g.arm").eqNullSafe(F.col("n.arm")) & F.col("g.task").eqNullSafe(F.col("n.task")) & F.col("g.k").eqNullSafe(F.col("n.k"))
    return g.join(n, same, "left").select("g.*", F.coalesce("n.n", F.lit(0)).alias("n"))


def s13_ranked_words(spark: SparkSession, d: str) -> DataFrame:
    """Type names by frequency, folded; of names that fold to one the most frequent is kept, and how many fell away."""
    words = nodes(spark, d).where("cell_type IS NOT NULL").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))
    words = words.withColumn("word", F.regexp_replace(F.lower(F.trim("cell_type")), "[^a-z0-9]", "")).where("word != ''")
    best = words.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("m"), "cell_type")).alias("b"), F.sum("n").alias("n"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))
    return best.select("word", F.col("b.cell_type").alias("kept"), "n", "n_duplicates")


def s14_syllables(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([(x,) for x in ("ka", "lo", "mi", "tu", "se")], "s string")
    return s.crossJoin(s.withColumnRenamed("s", "t")).crossJoin(s.withColumnRenamed("s", "u")).select(F.concat("s", "t", "u").alias("word"))  # 125 rows


def j8_aligned_order(spark: SparkSession, d: str) -> DataFrame:
    """Types and signs of the sources of the heaviest 500 pairs, in the pairs' order."""
    p = E.pairs(edges(spark, d)).orderBy(F.desc("w"), "pre", "post").limit(500)
    placed = p.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("w"), "pre", "post")))  # 500 rows
    return placed.join(nodes(spark, d).select(F.col("id").alias("pre"), "label", "sign_b"), "pre", "left").select("pos", "pre", "label", "sign_b")


def f4_any_column(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return n.select("side", any_contains([F.col("cell_type"), F.col("synonyms")], ["tract", "like"]).alias("hit")).groupBy("side", "hit").agg(F.count(F.lit(1)).alias("n"))


GATES = {(0, 0, 0, 1): "and", (0, 1, 1, 1): "or", (0, 1, 0, 0): "a_not_b", (0, 0, 1, 0): "b_not_a", (0, 1, 0, 1): "a", (0, 0, 1, 1): "b", (0, 0, 0, 0): "silent"}


def g23_gates(spark: SparkSession, d: str) -> DataFrame:
    """What gate each opposed pair of inputs and its target make, by driving neither, one, the other and both inputs for 60 ms."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Membrane()
        cell, trial = np.array([0, 1, 0, 1]), np.array([1, 2, 3, 3])
        const = lambda x: np.full(4, x)
        drive = Drive(cell, trial, const(0.0), const(60.0), const(25.0), const(0.0))
        for batch in batches:
            out = []
            for a, b in zip(batch["w_exc"], batch["w_inh"]):
                s = m.spikes(Wiring(np.array([0, 1]), np.array([2, 2]), np.array([float(a), -float(b)]), 3), drive, 4, 60.0)
                fires = set(s[s[:, 1] == 2, 2].tolist())
                out.append(GATES.get(tuple(int(t in fires) for t in range(4)), "other"))
            yield pd.DataFrame({"post": batch["post"], "gate": out})

    pairs = j6_opposed(spark, d).where("w_inh >= 0.6 * w_exc").select("post", "w_exc", "w_inh")
    weights = pairs.select("w_exc", "w_inh").distinct().withColumn("post", F.lit(0).cast("long"))  # the target doesn't matter: each pair of weights is run once
    judged = weights.mapInPandas(lambda it: (pd.concat([b[["w_exc", "w_inh"]].reset_index(drop=True), next(judge(iter([b])))[["gate"]]], axis=1) for b in it), "w_exc long, w_inh long, gate string")
    return pairs.join(judged, ["w_exc", "w_inh"]).select("post", "w_exc", "w_inh", "gate")


QUERIES = {f.__name__: f for f in (
    g3_find, g30_modes, g26_raster, w11_interpolated, j12_phases, r10_effects, r12_routes, l5_scores, a25_vocabulary, l8_gauss_codes, a34_geometry, a33_danger, u7_grid, s13_ranked_words, s14_syllables, j8_aligned_order, f4_any_column, g23_gates,
)}

EN, T = sql(SQL_EDGES, SQL_NODES), sql(SQL_TRIALS)
L5 = sql(SQL_NODES) + """, nm AS (SELECT cell_type, cell_class, count(*) AS n FROM nodes WHERE cell_type IS NOT NULL AND cell_class IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, '^' || lower(cell_type) || '$' AS p FROM nm),
    g AS (SELECT DISTINCT cell_type, cell_class, n, substr(p, i, 3) AS g FROM (SELECT *, unnest(range(1, length(p) - 1)) AS i FROM p)), sh AS (SELECT g, cell_class AS cls, sum(n) AS n FROM g GROUP BY 1, 2),
    wt AS (SELECT g, cls, n / sum(n) OVER (PARTITION BY g) AS w FROM sh), z AS (SELECT cell_type, cls, round(sum(w), 9) AS z FROM (SELECT DISTINCT cell_type, g FROM g) JOIN wt USING (g) GROUP BY 1, 2),
    t AS (SELECT cell_type, max(z) AS top FROM z GROUP BY 1), l5 AS (SELECT cell_type, min(cls) FILTER (z = top) AS cls, round(1 / sum(exp((z - top) / 0.4)), 6) AS confidence FROM z JOIN t USING (cell_type) GROUP BY 1)"""
OVER = """, c AS (SELECT DISTINCT np AS i, pre AS x FROM edges WHERE np IS NOT NULL), n AS (SELECT i, count(*) AS n FROM c GROUP BY 1), k AS (SELECT a.i AS a, b.i AS b, count(*) AS common FROM c a JOIN c b ON a.x = b.x AND a.i < b.i GROUP BY 1, 2),
    o AS (SELECT a, b, round(common / (p.n + q.n - common), 6) AS jaccard FROM k JOIN n p ON p.i = a JOIN n q ON q.i = b)"""
SQL = {
    "g3_find": sql(SQL_NODES) + """, q(search, term) AS (VALUES ('the mushroom body', 'kenyon'), ('the mushroom body', 'mbon'), ('compass', 'ring'), ('compass', 'wedge'), ('smell and compass', 'ring'), ('smell and compass', 'wedge'),
        ('smell and compass', 'pn'), ('smell and compass', 'lhln'), ('optic', 'optic')), h AS (SELECT DISTINCT search, id FROM nodes JOIN q ON contains(lower(concat_ws(chr(1), cell_type, cell_class, super_class, synonyms)), term)),
        r AS (SELECT search, id, row_number() OVER (PARTITION BY search ORDER BY id) AS k, count(*) OVER (PARTITION BY search) AS n_matches FROM h) SELECT search, n_matches, id FROM r WHERE k <= 15""",
    "g30_modes": EN + """, c AS (SELECT post, cell_class, count(*) AS n FROM edges JOIN nodes ON id = pre WHERE cell_class IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY post ORDER BY n DESC, cell_class) AS k FROM c)
        SELECT post, n, cell_class FROM r WHERE k = 1""",
    "g26_raster": EN + """, s AS (SELECT post, sum(w) AS w FROM edges GROUP BY 1) SELECT CAST(least(21, floor((pos_x - 20000) / 230000 * 22)) AS INTEGER) AS gx, CAST(least(21, floor((pos_y - 0) / 150000 * 22)) AS INTEGER) AS gy, CAST(max(w) AS BIGINT) AS w
        FROM nodes JOIN s ON post = id WHERE pos_x BETWEEN 20000 AND 250000 AND pos_y BETWEEN 0 AND 150000 GROUP BY 1, 2""",
    "w11_interpolated": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, avg(value) AS v FROM events GROUP BY 1, 2), p AS (SELECT user_id, s AS s0, v AS v0, lead(s) OVER w AS s1, lead(v) OVER w AS v1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s)),
        q AS (SELECT *, unnest(range(CAST(ceil((s0 - 43200) / 86400) AS BIGINT), CAST(ceil((s1 - 43200) / 86400) AS BIGINT))) AS day FROM p WHERE s1 IS NOT NULL)
        SELECT user_id, day, round(v0 + (v1 - v0) * (day * 86400 + 43200 - s0) / (s1 - s0), 6) AS value FROM q""",
    "j12_phases": """WITH p(phase, lo, hi) AS (VALUES ('cue', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-11'), ('hold', TIMESTAMP '2024-01-11', TIMESTAMP '2024-01-21'), ('turn', TIMESTAMP '2024-01-21', TIMESTAMP '2024-02-01'))
        SELECT phase, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN p ON ts >= lo AND ts < hi GROUP BY 1, 2""",
    "r10_effects": """WITH q(event_type, hunger, energy) AS (VALUES ('purchase', -35.0::DOUBLE, 8.0::DOUBLE), ('click', -5.0, 0.5), ('view', 1.0, -1.0))
        SELECT user_id, round(coalesce(sum(hunger), 0), 6) AS hunger, round(coalesce(sum(energy), 0), 6) AS energy, count(*) FILTER (hunger IS NULL) AS n_without_rule FROM events LEFT JOIN q USING (event_type) GROUP BY 1""",
    "r12_routes": r"""SELECT CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty' WHEN regexp_matches(lower(text), '(^|\n|: )(teach|öğret): ') THEN 'teach' WHEN regexp_matches(text, '\d+ [-+*/] \d+') THEN 'arithmetic'
        WHEN regexp_matches(lower(text), 'sugar|şeker|zucker|azúcar') THEN 'food' WHEN contains(lower(text), 'swat') THEN 'danger' ELSE 'unknown' END AS route, lower(lang) AS lang, count(*) AS n FROM documents GROUP BY 1, 2""",
    "l5_scores": L5 + " SELECT cell_type, cls, confidence FROM l5",
    "a25_vocabulary": L5 + """, r AS (SELECT cell_type, cell_class, row_number() OVER (PARTITION BY cell_type ORDER BY n DESC, cell_class) AS k FROM nm)
        SELECT count(*) AS n, round(avg(CAST(cls = cell_class AS INTEGER)), 6) AS accuracy, min(confidence) AS least, round(avg(confidence), 5) AS mean FROM l5 JOIN r USING (cell_type) WHERE k = 1""",
    "l8_gauss_codes": """WITH g AS (SELECT CAST(n AS INTEGER) AS n, CAST(unit AS INTEGER) AS unit FROM range(1, 10) a(n), range(20) b(unit))
        SELECT n, unit, round(exp(-pow(n - (1 + unit * (8.0::DOUBLE / 19.0::DOUBLE)), 2) / (2 * 0.8::DOUBLE * 0.8::DOUBLE)), 6) AS code, CAST(unit < n * 2 AS INTEGER) AS thermo FROM g""",
    "a34_geometry": sql(SQL_EDGES) + OVER + """, e AS (SELECT p, max(jaccard) AS best FROM (SELECT a AS p, jaccard FROM o UNION ALL SELECT b, jaccard FROM o) GROUP BY 1)
        SELECT count(*) AS pairs, round(avg(jaccard), 6) AS mean, round(quantile_cont(jaccard, 0.5), 6) AS median, round(quantile_cont(jaccard, 0.95), 6) AS p95, max(jaccard) AS most, (SELECT round(avg(best), 6) FROM e) AS mean_best, (SELECT min(best) FROM e) AS least_best FROM o""",
    "a33_danger": sql(SQL_EDGES) + """, s AS (SELECT np, post, sum(w) AS w FROM edges WHERE np IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY np ORDER BY w DESC) AS r FROM s), c AS (SELECT np, post FROM r WHERE r <= 30),
        b AS (SELECT DISTINCT post FROM c WHERE np IN (SELECT np FROM s GROUP BY 1 ORDER BY sum(w) DESC, np LIMIT 3)) SELECT np, count(*) AS n, round(count(b.post) / count(*), 6) AS danger FROM c LEFT JOIN b USING (post) GROUP BY 1""",
    "u7_grid": T + """, g AS (SELECT * FROM (SELECT DISTINCT arm FROM runs), (SELECT DISTINCT task FROM runs), (SELECT DISTINCT k FROM runs)), n AS (SELECT arm, task, k, count(*) AS n FROM runs GROUP BY 1, 2, 3)
        SELECT g.arm, g.task, g.k, coalesce(n, 0) AS n FROM g LEFT JOIN n ON g.arm IS NOT DISTINCT FROM n.arm AND g.task IS NOT DISTINCT FROM n.task AND g.k IS NOT DISTINCT FROM n.k""",
    "s13_ranked_words": sql(SQL_NODES) + """, w AS (SELECT cell_type, count(*) AS n, regexp_replace(lower(trim(cell_type, ' ')), '[^a-z0-9]', '', 'g') AS word FROM nodes WHERE cell_type IS NOT NULL GROUP BY 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, cell_type) AS k FROM w WHERE word <> '') SELECT word, min(cell_type) FILTER (k = 1) AS kept, CAST(sum(n) AS BIGINT) AS n, count(*) - 1 AS n_duplicates FROM r GROUP BY 1""",
    "s14_syllables": "WITH s(s) AS (VALUES ('ka'), ('lo'), ('mi'), ('tu'), ('se')) SELECT a.s || b.s || c.s AS word FROM s a, s b, s c",
    "j8_aligned_order": EN + """, p AS (SELECT pre, post, sum(w) AS w FROM edges GROUP BY 1, 2), r AS (SELECT pre, CAST(row_number() OVER (ORDER BY w DESC, pre, post) AS INTEGER) AS pos FROM p)
        SELECT pos, pre, label, sign_b FROM r LEFT JOIN nodes ON id = pre WHERE pos <= 500""",
    "f4_any_column": sql(SQL_NODES) + """ SELECT side, coalesce(contains(lower(cell_type), 'tract'), false) OR coalesce(contains(lower(cell_type), 'like'), false) OR coalesce(contains(lower(synonyms), 'tract'), false) OR coalesce(contains(lower(synonyms), 'like'), false) AS hit,
        count(*) AS n FROM nodes GROUP BY 1, 2""",
}
