"""Scans, filters and joins over edges and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.functions.cells import any_contains, by_prefix, same_text
from axonlake.operators import edges as E
from axonlake.operators.dense_ids import dense_ids
from axonlake.plans.views import SQL_EDGES, SQL_NODES, SQL_TRIALS, edges, nodes, sql, trials
from axonlake.sources.ingest import resolved
from axonlake.sources.tables import table

ALIASES = {"pre": ["pre_pt_root_id", "pre_root_id", "pre_id", "pre"], "post": ["post_pt_root_id", "post_root_id", "post_id", "post"], "w": ["syn_count", "n_syn", "weight", "count", "syns", "n"]}


def ids(frame: DataFrame) -> DataFrame:
    return frame.select("id").distinct()


def s2_alias_scan(spark: SparkSession, d: str) -> DataFrame:
    got = resolved(table(spark, d, "connections"), ALIASES).where("w IS NOT NULL")
    return got.groupBy("post").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("w").alias("w"))


def s6_dense_ids(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return dense_ids(e.select(F.col("pre").alias("id")).unionAll(e.select("post")), "id")


def s7_union_of_shapes(spark: SparkSession, d: str) -> DataFrame:
    t = trials(spark, d)
    memory = t.where("task = 'T1'").select("trial_id", "arm", "acc", "n_classes")
    timing = t.where("task = 'T3'").select("trial_id", "arm", "acc", "target", "tol")
    return memory.unionByName(timing, allowMissingColumns=True)


def s19_todo(spark: SparkSession, d: str) -> DataFrame:
    """Arm and seed pairs with a trial but no shard yet."""
    done = table(spark, d, "shards").select("arm", "seed")
    return trials(spark, d).select("arm", "seed").distinct().join(done, ["arm", "seed"], "left_anti")


def s17_urls(spark: SparkSession, d: str) -> DataFrame:
    """A link per super class to at most 50 of its cells, the smallest ids."""
    rank = F.row_number().over(Window.partitionBy("super_class").orderBy("id"))
    few = nodes(spark, d).where("super_class IS NOT NULL").select("super_class", "id").withColumn("k", rank).where("k <= 50")
    packed = few.groupBy("super_class").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    return packed.select("super_class", F.concat(F.lit("https://example.org/#!"), F.url_encode(F.concat(F.lit('{"segments":['), "ids", F.lit("]}")))).alias("url"))


def f2_exact(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where(same_text(F.col("cell_class"), "kenyon_cell")).select("id", "cell_type")


def f3_one_of(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where(F.coalesce(F.col("super_class").rlike("(?i)^(?:sensory|motor|ascending)$"), F.lit(False))).select("id", "super_class", "side")


def f4_contains(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where(any_contains([F.col(c) for c in ("cell_type", "cell_class", "super_class", "synonyms")], ["ring", "optic"])).select("id", "label")


def f5_prefixes(spark: SparkSession, d: str) -> DataFrame:
    kind = by_prefix(F.col("cell_type"), {"Ring": "ring", "Wedge": "wedge", "Fan": "fan", "Vpl": "vpl"})
    return nodes(spark, d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def f6_side(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where(F.lower("side") == "left").groupBy("cell_class").agg(F.count(F.lit(1)).alias("n"))


CENSUS = ["flow", "super_class", "cell_class", "cell_type", "side", "top_nt", "known_nt"]


def f7_null_census(spark: SparkSession, d: str) -> DataFrame:
    """Per column: rows, values, nulls, distinct values. The columns are stacked first, so the distinct counts are one aggregation by (column, value)."""
    cells = nodes(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in CENSUS])).alias("c")).select("c.*")
    each = cells.groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("field").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"), F.count("v").alias("n_distinct"),
    )


def f8_all_set(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return n.where(" AND ".join(f"{c} IS NOT NULL" for c in ("pos_x", "pos_y", "pos_z", "soma_x", "cell_type"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def f9_flags(spark: SparkSession, d: str) -> DataFrame:
    p = E.pairs(edges(spark, d), F.count(F.lit(1)).alias("n"), F.max("w").alias("top"))
    return p.select("pre", "post", (F.col("w") >= 10).alias("u1"), (F.col("n") >= 2).alias("u2"), (F.col("top") * 2 >= F.col("w")).alias("u3")).where("u1 AND u2 AND u3")


def f11_since(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 events after number 500 of two kinds, with a mark whether there are more."""
    ev = table(spark, d, "events").where("event_id > 500 AND event_type IN ('click', 'view', 'purchase')").select("event_id", "event_type")
    page = ev.orderBy("event_id").limit(101).withColumn("k", F.row_number().over(Window.orderBy("event_id")))  # 101 rows
    return page.withColumn("truncated", F.max("k").over(Window.partitionBy()) > 100).where("k <= 100").drop("k")


def j1_induced(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return E.induced(edges(spark, d), ids(n.where("super_class = 'central'")), n.select("id", F.col("sign_a").alias("sign")), 5)


def j2_bipartite(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    rows = E.slice_between(E.strong(edges(spark, d), 3), ids(n.where("super_class = 'sensory'")), ids(n.where("super_class = 'optic'")))
    return E.pairs(rows, F.count(F.lit(1)).alias("n"))


def j2_both_ways(spark: SparkSession, d: str) -> DataFrame:
    n = ids(nodes(spark, d).where("cell_class = 'Kenyon_Cell'"))
    return E.both_ways(E.slice_between(edges(spark, d), n, n))


def j3_fan_in_slice(spark: SparkSession, d: str) -> DataFrame:
    rows = E.within(edges(spark, d), "post", ids(nodes(spark, d).where("cell_class = 'Kenyon_Cell'")))
    return rows.groupBy("post").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


def j4_touching(spark: SparkSession, d: str) -> DataFrame:
    rows = E.touching(edges(spark, d), ids(nodes(spark, d).where("super_class = 'endocrine'")))
    return rows.groupBy("np").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


def j5_fan_in(spark: SparkSession, d: str) -> DataFrame:
    return E.fan_in(edges(spark, d), nodes(spark, d), "cell_class")


def a2_strong_fan_in(spark: SparkSession, d: str) -> DataFrame:
    return E.fan_in(E.strong(edges(spark, d), 3), nodes(spark, d), "cell_class")


def signed(spark: SparkSession, d: str, least: int = 5) -> DataFrame:
    return E.pairs(E.strong(edges(spark, d), least)).join(nodes(spark, d).select(F.col("id").alias("pre"), "sign_a"), "pre")


def j6_opposed(spark: SparkSession, d: str) -> DataFrame:
    """Each target's strongest exciting and strongest inhibiting input."""
    s = signed(spark, d)
    up = E.strongest(s.where("sign_a = 1"), "post", "pre").withColumnsRenamed({"pre": "exciter", "w": "w_exc"})
    down = E.strongest(s.where("sign_a = -1"), "post", "pre").withColumnsRenamed({"pre": "inhibitor", "w": "w_inh"})
    return up.join(down, "post")


def j7_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = edges(spark, d).join(nodes(spark, d).select(F.col("id").alias("post"), "label"), "post", "left")
    return rows.groupBy(F.coalesce("label", F.lit("?")).alias("label")).agg(F.sum("w").alias("w"))


def j10_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Targets of both optic and sensory cells, with the weight from either."""
    n, e = nodes(spark, d), E.strong(edges(spark, d), 3)
    from_kind = lambda k: E.within(e, "pre", ids(n.where(F.col("super_class") == k))).groupBy("post").agg(F.sum("w").alias(f"w_{k}"))
    return from_kind("optic").join(from_kind("sensory"), "post")


def j15_reciprocity(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    per = E.returned(e).groupBy("pre").agg(F.count(F.lit(1)).alias("n_returned"))
    return e.select("pre", "post").distinct().groupBy("pre").agg(F.count(F.lit(1)).alias("n_pairs")).join(per, "pre", "left").fillna(0, ["n_returned"])


def j16_through(spark: SparkSession, d: str) -> DataFrame:
    return E.through(edges(spark, d)).groupBy("np").agg(F.count(F.lit(1)).alias("n"))


def j17_best_partner(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    best = E.strongest(E.pairs(E.within(edges(spark, d), "pre", ids(n.where("super_class = 'optic'")))), "post", "pre")
    return n.where("cell_class = 'medulla_intrinsic'").select(F.col("id").alias("post")).join(best, "post", "left")


def j18_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Weight by target from left and from right cells, 0 where there is none."""
    n, e = nodes(spark, d), edges(spark, d)
    by = lambda s: E.within(e, "pre", ids(n.where(F.col("side") == s))).groupBy("post").agg(F.sum("w").alias(f"w_{s}"))
    return by("left").join(by("right"), "post", "full").fillna(0)


def j9_paired_arms(spark: SparkSession, d: str) -> DataFrame:
    """Seeds run in both arms, with both mean accuracies."""
    t = trials(spark, d).where("acc IS NOT NULL")
    by = lambda a: t.where(F.col("arm") == a).groupBy("seed").agg(F.round(F.avg("acc"), 9).alias(a))
    return by("mb_wired").join(by("cx_wired"), "seed")


def u2_first_row(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of every edge."""
    rows = table(spark, d, "connections").groupBy("edge_id").agg(F.min("loaded_at").alias("first_loaded_at"), F.count(F.lit(1)).alias("n_deliveries"))
    return rows.where("n_deliveries > 1")


def u3_sets(spark: SparkSession, d: str) -> DataFrame:
    e, n = edges(spark, d), ids(nodes(spark, d))
    pre, post = e.select(F.col("pre").alias("id")), e.select(F.col("post").alias("id"))
    count = lambda name, x: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
    return count("both", pre.intersect(post)).unionAll(count("source_only", pre.subtract(post))).unionAll(count("any", pre.union(post).distinct())).unionAll(count("unknown", pre.union(post).distinct().join(n, "id", "left_anti")))


QUERIES = {f.__name__: f for f in (
    s2_alias_scan, s6_dense_ids, s7_union_of_shapes, s17_urls, s19_todo, f2_exact, f3_one_of, f4_contains, f5_prefixes, f6_side, f7_null_census, f8_all_set, f9_flags, f11_since, j1_induced,
    j2_bipartite, j2_both_ways, j3_fan_in_slice, j4_touching, j5_fan_in, a2_strong_fan_in, j6_opposed, j7_labels, j9_paired_arms, j10_overlap, j15_reciprocity, j16_through, j17_best_partner, j18_aligned, u2_first_row, u3_sets,
)}

EN = sql(SQL_EDGES, SQL_NODES)
SQL = {
    "s2_alias_scan": "SELECT post_pt_root_id AS post, count(*) AS n_rows, CAST(sum(syn_count) AS BIGINT) AS w FROM connections WHERE syn_count IS NOT NULL GROUP BY 1",
    "s6_dense_ids": sql(SQL_EDGES) + " SELECT id, row_number() OVER (ORDER BY id) - 1 AS dense FROM (SELECT pre AS id FROM edges UNION SELECT post FROM edges)",
    "s7_union_of_shapes": sql(SQL_TRIALS) + " SELECT trial_id, arm, acc, CASE WHEN task = 'T1' THEN n_classes END AS n_classes, CASE WHEN task = 'T3' THEN target END AS target, CASE WHEN task = 'T3' THEN tol END AS tol FROM runs WHERE task IN ('T1', 'T3')",
    "s17_urls": sql(SQL_NODES) + """, few AS (SELECT super_class, id, row_number() OVER (PARTITION BY super_class ORDER BY id) AS k FROM nodes WHERE super_class IS NOT NULL)
        SELECT super_class, 'https://example.org/#!' || url_encode('{"segments":[' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) || ']}') AS url FROM few WHERE k <= 50 GROUP BY 1""",
    "s19_todo": "SELECT DISTINCT arm, seed FROM trials t WHERE NOT EXISTS (SELECT 1 FROM shards s WHERE s.arm = t.arm AND s.seed = t.seed)",
    "f2_exact": sql(SQL_NODES) + " SELECT id, cell_type FROM nodes WHERE lower(cell_class) = 'kenyon_cell'",
    "f3_one_of": sql(SQL_NODES) + " SELECT id, super_class, side FROM nodes WHERE lower(super_class) IN ('sensory', 'motor', 'ascending')",
    "f4_contains": sql(SQL_NODES) + """ SELECT id, label FROM nodes WHERE concat_ws(chr(1), lower(cell_type), lower(cell_class), lower(super_class), lower(synonyms)) LIKE '%ring%'
        OR concat_ws(chr(1), lower(cell_type), lower(cell_class), lower(super_class), lower(synonyms)) LIKE '%optic%'""",
    "f5_prefixes": sql(SQL_NODES) + """ SELECT CASE WHEN cell_type IS NULL THEN '?' WHEN cell_type LIKE 'Ring%' THEN 'ring' WHEN cell_type LIKE 'Wedge%' THEN 'wedge' WHEN cell_type LIKE 'Fan%' THEN 'fan'
        WHEN cell_type LIKE 'Vpl%' THEN 'vpl' ELSE 'other' END AS kind, count(*) AS n FROM nodes GROUP BY 1""",
    "f6_side": sql(SQL_NODES) + " SELECT cell_class, count(*) AS n FROM nodes WHERE lower(side) = 'left' GROUP BY 1",
    "f7_null_census": sql(SQL_NODES) + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n_rows, count({c}) AS n_values, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct FROM nodes" for c in CENSUS),
    "f8_all_set": sql(SQL_NODES) + " SELECT side, count(*) AS n FROM nodes WHERE pos_x IS NOT NULL AND pos_y IS NOT NULL AND pos_z IS NOT NULL AND soma_x IS NOT NULL AND cell_type IS NOT NULL GROUP BY 1",
    "f9_flags": sql(SQL_EDGES) + " SELECT pre, post, true AS u1, true AS u2, true AS u3 FROM edges GROUP BY pre, post HAVING sum(w) >= 10 AND count(*) >= 2 AND max(w) * 2 >= sum(w)",
    "f11_since": """WITH page AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_id > 500 AND event_type IN ('click', 'view', 'purchase'))
        SELECT event_id, event_type, (SELECT max(k) FROM page) > 100 AS truncated FROM page WHERE k <= 100""",
    "j1_induced": EN + """ SELECT e.post, e.pre, CAST(sum(w * a.sign_a) AS BIGINT) AS v FROM edges e JOIN nodes a ON a.id = e.pre JOIN nodes b ON b.id = e.post
        WHERE w >= 5 AND a.super_class = 'central' AND b.super_class = 'central' GROUP BY 1, 2""",
    "j2_bipartite": EN + """ SELECT e.pre, e.post, CAST(sum(w) AS BIGINT) AS w, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.pre JOIN nodes b ON b.id = e.post
        WHERE w >= 3 AND a.super_class = 'sensory' AND b.super_class = 'optic' GROUP BY 1, 2""",
    "j2_both_ways": EN + """, s AS (SELECT pre, post, w FROM edges WHERE pre IN (SELECT id FROM nodes WHERE cell_class = 'Kenyon_Cell') AND post IN (SELECT id FROM nodes WHERE cell_class = 'Kenyon_Cell'))
        SELECT pre, post, CAST(sum(w) AS BIGINT) AS w FROM (SELECT * FROM s UNION ALL SELECT post, pre, w FROM s) GROUP BY 1, 2""",
    "j3_fan_in_slice": EN + " SELECT post, count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM edges WHERE post IN (SELECT id FROM nodes WHERE cell_class = 'Kenyon_Cell') GROUP BY 1",
    "j4_touching": EN + """, s AS (SELECT id FROM nodes WHERE super_class = 'endocrine')
        SELECT np, count(*) AS n, CAST(sum(w) AS BIGINT) AS w FROM edges WHERE pre IN (SELECT id FROM s) OR post IN (SELECT id FROM s) GROUP BY 1""",
    "j5_fan_in": EN + " SELECT cell_class, count(DISTINCT pre) AS n_pre, count(*) AS n_edges, CAST(sum(w) AS BIGINT) AS n_syn FROM edges JOIN nodes ON id = pre WHERE cell_class IS NOT NULL GROUP BY 1",
    "a2_strong_fan_in": EN + " SELECT cell_class, count(DISTINCT pre) AS n_pre, count(*) AS n_edges, CAST(sum(w) AS BIGINT) AS n_syn FROM edges JOIN nodes ON id = pre WHERE cell_class IS NOT NULL AND w >= 3 GROUP BY 1",
    "j6_opposed": EN + """, p AS (SELECT pre, post, sum(w) AS w, any_value(sign_a) AS s FROM edges JOIN nodes ON id = pre WHERE w >= 5 GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY post, s ORDER BY w DESC, pre) AS k FROM p)
        SELECT a.post, a.pre AS exciter, CAST(a.w AS BIGINT) AS w_exc, b.pre AS inhibitor, CAST(b.w AS BIGINT) AS w_inh FROM r a JOIN r b ON a.post = b.post WHERE a.k = 1 AND b.k = 1 AND a.s = 1 AND b.s = -1""",
    "j7_labels": EN + " SELECT coalesce(label, '?') AS label, CAST(sum(w) AS BIGINT) AS w FROM edges LEFT JOIN nodes ON id = post GROUP BY 1",
    "j9_paired_arms": sql(SQL_TRIALS) + """ SELECT seed, round(avg(acc) FILTER (arm = 'mb_wired'), 9) AS mb_wired, round(avg(acc) FILTER (arm = 'cx_wired'), 9) AS cx_wired FROM runs WHERE acc IS NOT NULL
        GROUP BY seed HAVING count(*) FILTER (arm = 'mb_wired') > 0 AND count(*) FILTER (arm = 'cx_wired') > 0""",
    "j10_overlap": EN + """ SELECT post, CAST(sum(w) FILTER (super_class = 'optic') AS BIGINT) AS w_optic, CAST(sum(w) FILTER (super_class = 'sensory') AS BIGINT) AS w_sensory FROM edges JOIN nodes ON id = pre
        WHERE w >= 3 GROUP BY post HAVING count(*) FILTER (super_class = 'optic') > 0 AND count(*) FILTER (super_class = 'sensory') > 0""",
    "j15_reciprocity": sql(SQL_EDGES) + """, p AS (SELECT DISTINCT pre, post FROM edges)
        SELECT a.pre, count(*) AS n_pairs, count(b.pre) AS n_returned FROM p a LEFT JOIN p b ON a.pre = b.post AND a.post = b.pre GROUP BY 1""",
    "j16_through": sql(SQL_EDGES) + """, i AS (SELECT pre AS id FROM edges INTERSECT SELECT post FROM edges)
        SELECT np, count(*) AS n FROM edges WHERE pre IN (SELECT id FROM i) AND post IN (SELECT id FROM i) GROUP BY 1""",
    "j17_best_partner": EN + """, p AS (SELECT post, pre, sum(w) AS w FROM edges JOIN nodes ON id = pre WHERE super_class = 'optic' GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY post ORDER BY w DESC, pre) AS k FROM p)
        SELECT n.id AS post, r.pre, CAST(r.w AS BIGINT) AS w FROM nodes n LEFT JOIN r ON r.post = n.id AND k = 1 WHERE cell_class = 'medulla_intrinsic'""",
    "j18_aligned": EN + """ SELECT post, CAST(coalesce(sum(w) FILTER (side = 'left'), 0) AS BIGINT) AS w_left, CAST(coalesce(sum(w) FILTER (side = 'right'), 0) AS BIGINT) AS w_right FROM edges JOIN nodes ON id = pre
        WHERE side IN ('left', 'right') GROUP BY 1""",
    "u2_first_row": "SELECT edge_id, min(loaded_at) AS first_loaded_at, count(*) AS n_deliveries FROM connections GROUP BY 1 HAVING count(*) > 1",
    "u3_sets": EN + """, a AS (SELECT DISTINCT pre AS id FROM edges), b AS (SELECT DISTINCT post AS id FROM edges)
        SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'source_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'unknown', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) WHERE id NOT IN (SELECT id FROM nodes)""",
}
