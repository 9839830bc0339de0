"""Neighbourhoods, components, codes, text and the arithmetic controller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonlake.functions.cells import wrapped
from axonlake.functions.text import keyed_hash, ngrams, tokens
from axonlake.operators import codes as C
from axonlake.operators import controller as K
from axonlake.operators import edges as E
from axonlake.operators import graph_iter as G
from axonlake.operators import lexicon as X
from axonlake.plans.views import SQL_EDGES, SQL_NODES, edges, nodes, sql
from axonlake.sources.tables import table

PI = 3.141592653589793


def g1_levels(spark: SparkSession, d: str) -> DataFrame:
    """Who is within 2 hops of the left Kenyon cells, by rows of weight 5 and more."""
    seeds = nodes(spark, d).where("cell_class = 'Kenyon_Cell' AND side = 'left'").select("id")
    return G.levels(E.strong(edges(spark, d), 5), seeds, 2).select("id", F.col("hop").cast("long").alias("hop"))


def g1_all_levels(spark: SparkSession, d: str) -> DataFrame:
    """g1_levels over all edge rows, to the last level."""
    seeds = nodes(spark, d).where("cell_class = 'Kenyon_Cell' AND side = 'left'").select("id")
    return G.levels(edges(spark, d), seeds, 1 << 30).select("id", F.col("hop").cast("long").alias("hop"))


def g1_subcircuit(spark: SparkSession, d: str) -> DataFrame:
    """The first 1,500 cells downstream of one class, with the signed weights between them."""
    n, e = nodes(spark, d), edges(spark, d)
    got = G.levels(E.strong(e, 5), n.where("cell_class = 'MBON'").select("id"), 2, limit=1500)
    return E.induced(e, got.select("id"), n.select("id", F.col("sign_a").alias("sign")), 5)


def g2_paths(spark: SparkSession, d: str) -> DataFrame:
    """One shortest path between two classes, with the synapses of each hop from all rows of the pair."""
    n, e = nodes(spark, d), edges(spark, d)
    path = G.shortest_path(E.strong(e, 5), n.where("super_class = 'sensory'").select("id"), n.where("super_class = 'motor'").select("id")) or []
    hops = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:]))], "hop int, pre long, post long")
    return hops.join(E.pairs(e), ["pre", "post"], "left")


def g4_largest_scc(spark: SparkSession, d: str) -> DataFrame:
    return G.largest_scc(E.strong(edges(spark, d), 5))


def g5_components(spark: SparkSession, d: str) -> DataFrame:
    """Components by rows of weight 5 and more."""
    return G.components(E.strong(edges(spark, d), 5))


def g5_all_components(spark: SparkSession, d: str) -> DataFrame:
    """Components over all edge rows."""
    return G.components(edges(spark, d))


def g6_radius(spark: SparkSession, d: str) -> DataFrame:
    """The spectral radius of the pairs' weights, to the reference's 400 rounds and tolerance, with every entry of the vector; converged is false if the rounds ran out."""
    radius, v, converged = G.spectrum(edges(spark, d, "pre", "post"), 400, 1e-12)
    return v.select("id", "x", F.lit(radius).alias("radius"), F.lit(converged).alias("converged"))


def g6_rounded(spark: SparkSession, d: str) -> DataFrame:
    """g6_radius to five digits."""
    return g6_radius(spark, d).select("id", F.round("x", 5).alias("x"), F.round("radius", 4).alias("radius"))


def g2_hops(spark: SparkSession, d: str) -> DataFrame:
    """How many hops the path of g2_paths has, and whether all its pairs exist."""
    return g2_paths(spark, d).agg(F.count(F.lit(1)).alias("hops"), F.count("w").alias("existing"))


def g4_size(spark: SparkSession, d: str) -> DataFrame:
    """Whether every node of the component of g4_largest_scc reaches, and is reached by, exactly the same nodes: its size and the number of nodes that its first node reaches and is reached from."""
    return g4_largest_scc(spark, d).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


LEXICON = {  # fixed values: words of the domain by what they ask for
    "sugar": "food", "şeker": "food", "zucker": "food", "azúcar": "food", "hungry": "food", "hunger": "food", "aç": "food", "hambre": "food", "swat": "danger", "vurma": "danger", "schlagen": "danger", "stop": "command",
    "durdun": "command", "teach": "command", "öğret": "command", "edge table": "record", "kenar tablosu": "record", "run log": "record", "seed": "record", "tohum": "record", "semilla": "record",
}
TAUGHT = {"seed": "number", "fliege": "self", "fly": "self", "sinek": "self", "mosca": "self"}


def _lexicon(spark: SparkSession) -> DataFrame:
    frame = lambda x: spark.createDataFrame(list(x.items()), "word string, category string")
    return X.resolved(frame(LEXICON), frame(TAUGHT))


def c5_keywords(spark: SparkSession, d: str) -> DataFrame:
    """In how many texts each keyword is found, and in how many it is the first."""
    got = X.hits(table(spark, d, "documents"), "doc_id", "text", _lexicon(spark))
    return got.groupBy("keyword", "category").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("place") == 1).alias("n_first"))


def c7_routes(spark: SparkSession, d: str) -> DataFrame:
    return X.routes(table(spark, d, "documents"), "doc_id", "text", _lexicon(spark)).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def c9_buckets(spark: SparkSession, d: str) -> DataFrame:
    """How evenly hashed trigrams of type names fall to 64 units."""
    grams = nodes(spark, d).where("cell_type IS NOT NULL").select(F.explode(ngrams(F.lower("cell_type"), 3)).alias("g")).distinct()
    return grams.select(F.pmod(keyed_hash(F.col("g"), 7), F.lit(64)).alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


def g27_products(spark: SparkSession, d: str) -> DataFrame:
    """Products, sums and differences of the quantities of order lines and their line numbers by gates, with the gates a product took."""
    q = table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("a"), F.col("l_linenumber").cast("int").alias("b")).distinct()
    m = K.multiplied(F.col("a"), F.col("b"), 8)
    return q.select("a", "b", m["value"].alias("product"), m["gates"].alias("gates"), *[K.computed(F.col("a"), F.lit(o), F.col("b"), 8).alias(n) for o, n in (("+", "sum"), ("-", "difference"))])


def l14_measured(spark: SparkSession, d: str) -> DataFrame:
    """How many of all tasks of 1 to 9 the controller answers rightly by operation, and how many steps it takes."""
    t = K.tables(spark, 9)
    true = F.when(F.col("op") == "add", F.col("a") + F.col("b")).when((F.col("op") == "subtract") & (F.col("a") >= F.col("b")), F.col("a") - F.col("b")).when(F.col("op") == "multiply", F.col("a") * F.col("b")).when(F.col("op") == "divide", F.floor(F.col("a") / F.col("b")))
    return t.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result").eqNullSafe(true)).alias("n_right"), F.sum("calls").alias("calls"), F.max("calls").alias("most_calls"))


def t3_winners(spark: SparkSession, d: str) -> DataFrame:
    p = edges(spark, d).where("np IS NOT NULL").groupBy("np", "post").agg(F.sum("w").alias("w"))
    return C.winners(p, ["np"], "w", 10)


def t4_exactly(spark: SparkSession, d: str) -> DataFrame:
    p = edges(spark, d).where("np IS NOT NULL").groupBy("np", "post").agg(F.sum("w").alias("w"))
    return C.exactly(p, ["np"], "w", "post", 10)


def l6_coincidence(spark: SparkSession, d: str) -> DataFrame:
    """Targets with three or more active sources of a place's winners."""
    p = edges(spark, d).where("np IS NOT NULL").groupBy("np", "pre").agg(F.sum("w").alias("w"))
    code = C.winners(p, ["np"], "w", 20)
    return C.coincident(code, edges(spark, d), "np", "pre", 3)


def l7_rules(spark: SparkSession, d: str) -> DataFrame:
    """Per target: sources, synapses, and sources weighted by what share of their synapses go there."""
    p = E.pairs(edges(spark, d))
    out = p.groupBy("pre").agg(F.sum("w").alias("total"))
    return p.join(out, "pre").groupBy("post").agg(F.count(F.lit(1)).alias("by_count"), F.sum("w").alias("by_syn"), F.round(F.sum(F.col("w") / F.col("total")), 6).alias("by_share"))


def j14_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """How alike the sources of every two places are."""
    return C.overlaps(edges(spark, d), "np", "pre").select("a", "b", "common", F.round("jaccard", 6).alias("jaccard"))


def j13_sector(spark: SparkSession, d: str) -> DataFrame:
    """Cells within 45 degrees of one of eight headings around the middle of the volume."""
    n = nodes(spark, d).where("pos_x BETWEEN 20000 AND 250000 AND pos_y IS NOT NULL AND NOT isnan(pos_y)").select("id", F.atan2(F.col("pos_y") - 60000.0, F.col("pos_x") - 130000.0).alias("angle"))
    headings = spark.range(8).select(F.col("id").alias("heading"))  # 8 rows
    rows = n.join(F.broadcast(headings), F.abs(wrapped(F.col("angle") - F.col("heading") * (PI / 4))) <= PI / 8)
    return rows.groupBy("heading").agg(F.count(F.lit(1)).alias("n"))


def j20_circular_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Each event type's mean time of day and the nearest other type's, on the circle."""
    m = table(spark, d, "events").select("event_type", ((F.hour("ts") * 60 + F.minute("ts")) * (2 * PI / 1440)).alias("t")).groupBy("event_type").agg(F.atan2(F.sum(F.sin("t")), F.sum(F.cos("t"))).alias("a"))
    a, b = m.alias("a"), m.alias("b")  # one row per type
    pairs = a.join(b, F.col("a.event_type") != F.col("b.event_type")).select(F.col("a.event_type").alias("event_type"), F.round(F.abs(wrapped(F.col("a.a") - F.col("b.a"))), 6).alias("gap"))
    return pairs.groupBy("event_type").agg(F.min("gap").alias("gap"))


def j21_nearest_name(spark: SparkSession, d: str) -> DataFrame:
    """For each type name the most alike other one by trigrams (cosine of sets), the first by name on ties; 0 where none shares a trigram."""
    names = nodes(spark, d).where("label != '?'").select("label").distinct()
    grams = names.select("label", F.explode(F.array_distinct(ngrams(F.lower("label"), 3))).alias("g"))
    size = grams.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    a, b = grams.withColumnRenamed("label", "a"), grams.withColumnRenamed("label", "b")
    common = a.join(b, "g").where("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    s = common.join(size.select(F.col("label").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("label").alias("b"), F.col("n").alias("nb")), "b")
    s = s.withColumn("cos", F.round(F.col("c") / F.sqrt(F.col("na").cast("double") * F.col("nb")), 9))
    best = s.groupBy("a").agg(F.max("cos").alias("cos"))
    got = s.join(best, ["a", "cos"]).groupBy("a", "cos").agg(F.min("b").alias("b"))
    return names.join(got, names["label"] == got["a"], "left").select("label", F.col("b").alias("nearest"), F.coalesce("cos", F.lit(0.0)).alias("cos"))


def l4_nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors to every vector whose id is divisible by 50."""
    v = table(spark, d, "embeddings")
    got = C.nearest(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 3)
    return got.select("query", "item", F.round("cosine", 6).alias("cosine"), "place")


def l4_centroids(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors of each label lie nearest to which label's mean."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    mean = v.groupBy("label", "i").agg(F.avg("x").alias("m")).withColumnRenamed("label", "to_label")  # labels times dimensions
    length = mean.groupBy("to_label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("l"))
    dots = v.join(F.broadcast(mean), "i").groupBy("vec_id", "label", "to_label").agg(F.sum(F.col("x") * F.col("m")).alias("d")).join(F.broadcast(length), "to_label")
    best = dots.groupBy("vec_id", "label").agg(F.max(F.struct(F.round(F.col("d") / F.col("l"), 9).alias("s"), (-F.col("to_label")).alias("t"))).alias("b"))
    return best.groupBy("label", (-F.col("b.t")).alias("nearest")).agg(F.count(F.lit(1)).alias("n"))


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of every text after folding, with the number of texts that hold them; 3 texts or more."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts >= 3")


def text_grams(spark: SparkSession, d: str) -> DataFrame:
    names = nodes(spark, d).where("cell_type IS NOT NULL").select(F.lower("cell_type").alias("name"))
    return names.select(F.explode(ngrams(F.col("name"), 4)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_type", F.from_json("props", "k INT").getField("k").alias("k"))
    return ev.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def l12_controller(spark: SparkSession, d: str) -> DataFrame:
    return K.tables(spark, 9)


def l13_sums_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """The arithmetic asked for in the texts, answered or refused by the calculator's bounds."""
    asked = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\b(\d{1,3}) ([-+*/]) (\d{1,3})\b"), F.lit(0))).alias("asked"))
    return K.answered(asked.groupBy("asked").agg(F.count(F.lit(1)).alias("n")), "asked")


def g27_alu(spark: SparkSession, d: str) -> DataFrame:
    """Ripple-carry sums of the quantities of each order line and the next number, bit by bit."""
    q = table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("a"), F.col("l_linenumber").alias("b")).distinct()
    return q.select("a", "b", K.ripple_add(F.col("a"), F.col("b"), 8).alias("s"))


def l16_energy(spark: SparkSession, d: str) -> DataFrame:
    """Events times price per event beside a dense update, and their ratio, 0 where nothing happens."""
    out = edges(spark, d).groupBy("np").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("pre").alias("a"), F.count_distinct("post").alias("b"))
    dense = F.col("a") * F.col("b")
    return out.select("np", "events", dense.alias("dense"), F.round(F.coalesce(F.col("events") / F.nullif(dense, F.lit(0)), F.lit(0.0)), 6).alias("ratio"))


QUERIES = {f.__name__: f for f in (
    g1_levels, g1_all_levels, g1_subcircuit, g2_paths, g4_largest_scc, g5_components, g5_all_components, g6_radius, g6_rounded, g2_hops, g4_size, c5_keywords, c7_routes, c9_buckets, g27_products, l14_measured, t3_winners, t4_exactly, l6_coincidence, l7_rules, j14_overlaps, j13_sector, j20_circular_nearest, j21_nearest_name,
    l4_nearest_vectors, l4_centroids, text_tokens, text_grams, json_props, l12_controller, l13_sums_in_texts, g27_alu, l16_energy,
)}

EN = sql(SQL_EDGES, SQL_NODES)
# letters without marks by duckdb's own function; of letters that stand for two, these tables have two ligatures
_WORDS = """toks AS (SELECT doc_id, regexp_extract_all(strip_accents(replace(replace(replace(lower(text), 'ı', 'i'), 'ﬁ', 'fi'), 'ﬂ', 'fl')), '[a-z]+') AS t FROM documents)"""
_VALUES = lambda x: ", ".join(f"('{w}', '{c}')" for w, c in x.items())
_HITS = f""", lex AS (SELECT strip_accents(word) AS keyword, category FROM (VALUES {_VALUES(LEXICON)}) AS l(word, category)), own AS (SELECT * FROM (VALUES {_VALUES(TAUGHT)}) AS o(keyword, own)),
    known AS (SELECT keyword, coalesce(own, category) AS category FROM lex FULL JOIN own USING (keyword)), said AS (SELECT doc_id, unnest(t) AS w FROM toks),
    found AS (SELECT DISTINCT doc_id, keyword, category FROM said JOIN known ON w = keyword OR (length(keyword) >= 4 AND starts_with(w, keyword)) WHERE NOT contains(keyword, ' ')
              UNION SELECT doc_id, keyword, category FROM toks JOIN known ON contains(keyword, ' ') AND contains(' ' || array_to_string(t, ' ') || ' ', keyword)),
    hits AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(keyword) DESC, keyword) AS place FROM found)"""
NW = ", s AS (SELECT np, {0}, sum(w) AS w FROM edges WHERE np IS NOT NULL GROUP BY 1, 2)"
SQL = {
    "g1_levels": EN.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT DISTINCT pre, post FROM edges WHERE w >= 5),
        b AS (SELECT id, 0 AS hop FROM nodes WHERE cell_class = 'Kenyon_Cell' AND side = 'left' UNION SELECT e.post, hop + 1 FROM b JOIN e ON e.pre = b.id WHERE hop < 2)
        SELECT id, CAST(min(hop) AS BIGINT) AS hop FROM b GROUP BY 1""",
    "g1_all_levels": EN.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT DISTINCT pre, post FROM edges),
        b(id, hop) USING KEY (id) AS (SELECT id, 0 FROM nodes WHERE cell_class = 'Kenyon_Cell' AND side = 'left'
            UNION SELECT e.post, min(b.hop) + 1 FROM b JOIN e ON e.pre = b.id LEFT JOIN recurring.b AS r ON r.id = e.post WHERE r.id IS NULL OR r.hop > b.hop + 1 GROUP BY e.post)
        SELECT id, CAST(hop AS BIGINT) AS hop FROM b""",
    "g1_subcircuit": EN.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT DISTINCT pre, post FROM edges WHERE w >= 5), s AS (SELECT id FROM nodes WHERE cell_class = 'MBON'),
        h1 AS (SELECT post AS id, min(pre) AS parent FROM e WHERE pre IN (SELECT id FROM s) AND post NOT IN (SELECT id FROM s) GROUP BY 1),
        h2 AS (SELECT post AS id, min(pre) AS parent FROM e WHERE pre IN (SELECT id FROM h1) AND post NOT IN (SELECT id FROM s UNION SELECT id FROM h1) GROUP BY 1),
        f AS (SELECT id, 0 AS hop, NULL AS parent FROM s UNION ALL SELECT id, 1, parent FROM h1 UNION ALL SELECT id, 2, parent FROM h2 WHERE (SELECT count(*) FROM s) + (SELECT count(*) FROM h1) < 1500),
        k AS (SELECT id FROM f ORDER BY hop, parent NULLS FIRST, id LIMIT 1500)
        SELECT post, pre, CAST(sum(w * sign_a) AS BIGINT) AS v FROM edges JOIN nodes ON nodes.id = pre WHERE w >= 5 AND pre IN (SELECT id FROM k) AND post IN (SELECT id FROM k) GROUP BY 1, 2""",
    "g2_hops": EN.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT DISTINCT pre, post FROM edges WHERE w >= 5),
        b(id, hop) USING KEY (id) AS (SELECT id, 0 FROM nodes WHERE super_class = 'sensory'
            UNION SELECT e.post, min(b.hop) + 1 FROM b JOIN e ON e.pre = b.id LEFT JOIN recurring.b AS r ON r.id = e.post WHERE r.id IS NULL OR r.hop > b.hop + 1 GROUP BY e.post)
        SELECT CAST(coalesce(min(hop), 0) AS BIGINT) AS hops, CAST(coalesce(min(hop), 0) AS BIGINT) AS existing FROM b WHERE id IN (SELECT id FROM nodes WHERE super_class = 'motor')""",
    "g4_size": sql(SQL_EDGES).replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT DISTINCT pre, post FROM edges WHERE w >= 5 AND pre <> post),
        busiest AS (SELECT id FROM (SELECT post AS id, count(*) AS i FROM e GROUP BY 1) JOIN (SELECT pre AS id, count(*) AS o FROM e GROUP BY 1) USING (id) ORDER BY i * o DESC, id LIMIT 1),
        f AS (SELECT id FROM busiest UNION SELECT e.post FROM f JOIN e ON e.pre = f.id), g AS (SELECT id FROM busiest UNION SELECT e.pre FROM g JOIN e ON e.post = g.id)
        SELECT count(*) AS n, min(id) AS first FROM f WHERE id IN (SELECT id FROM g)""",
    "g5_components": sql(SQL_EDGES).replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT pre AS a, post AS b FROM edges WHERE w >= 5 UNION SELECT post, pre FROM edges WHERE w >= 5),
        c(id, comp) USING KEY (id) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(c.comp) FROM c JOIN e ON e.a = c.id JOIN recurring.c AS r ON r.id = e.b WHERE c.comp < r.comp GROUP BY e.b) SELECT id, comp FROM c""",
    "g5_all_components": sql(SQL_EDGES).replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT pre AS a, post AS b FROM edges UNION SELECT post, pre FROM edges),
        c(id, comp) USING KEY (id) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(c.comp) FROM c JOIN e ON e.a = c.id JOIN recurring.c AS r ON r.id = e.b WHERE c.comp < r.comp GROUP BY e.b) SELECT id, comp FROM c""",
    "g6_rounded": sql(SQL_EDGES).replace("WITH", "WITH RECURSIVE", 1) + """, p AS (SELECT pre, post, CAST(sum(w) AS DOUBLE) AS w FROM edges GROUP BY 1, 2), ids AS (SELECT pre AS id FROM p UNION SELECT post FROM p),
        v(k, id, x, radius) AS (SELECT 0, id, 1 / sqrt((SELECT count(*) FROM ids)), 0.0::DOUBLE FROM ids
            UNION ALL SELECT k, id, y / sqrt(sum(y * y) OVER ()), sqrt(sum(y * y) OVER ()) FROM (SELECT k + 1 AS k, post AS id, sum(w * x) AS y FROM v JOIN p ON pre = v.id WHERE k < 100 GROUP BY k, post)),
        l AS (SELECT * FROM v WHERE k = 100)
        SELECT ids.id, round(coalesce(x, 0), 5) AS x, round((SELECT max(radius) FROM l), 4) AS radius FROM ids LEFT JOIN l ON l.id = ids.id""",
    "t3_winners": sql(SQL_EDGES) + NW.format("post") + ", r AS (SELECT *, rank() OVER (PARTITION BY np ORDER BY w DESC) AS r FROM s) SELECT np, post, CAST(w AS BIGINT) AS w FROM r WHERE r <= 10",
    "t4_exactly": sql(SQL_EDGES) + NW.format("post") + ", r AS (SELECT *, row_number() OVER (PARTITION BY np ORDER BY w DESC, post) AS r FROM s) SELECT np, post, CAST(w AS BIGINT) AS w FROM r WHERE r <= 10",
    "l6_coincidence": sql(SQL_EDGES) + NW.format("pre") + """, r AS (SELECT *, rank() OVER (PARTITION BY np ORDER BY w DESC) AS r FROM s), c AS (SELECT np, pre FROM r WHERE r <= 20), e AS (SELECT DISTINCT pre, post FROM edges)
        SELECT np, post, count(*) AS n FROM c JOIN e USING (pre) GROUP BY 1, 2 HAVING count(*) >= 3""",
    "l7_rules": sql(SQL_EDGES) + """, p AS (SELECT pre, post, sum(w) AS w FROM edges GROUP BY 1, 2), t AS (SELECT *, w / sum(w) OVER (PARTITION BY pre) AS share FROM p)
        SELECT post, count(*) AS by_count, CAST(sum(w) AS BIGINT) AS by_syn, round(sum(share), 6) AS by_share FROM t GROUP BY 1""",
    "j14_overlaps": sql(SQL_EDGES) + """, c AS (SELECT DISTINCT np AS i, pre AS x FROM edges WHERE np IS NOT NULL), n AS (SELECT i, count(*) AS n FROM c GROUP BY 1),
        k AS (SELECT a.i AS a, b.i AS b, count(*) AS common FROM c a JOIN c b ON a.x = b.x AND a.i < b.i GROUP BY 1, 2)
        SELECT a, b, common, round(common / (p.n + q.n - common), 6) AS jaccard FROM k JOIN n p ON p.i = a JOIN n q ON q.i = b""",
    "j13_sector": sql(SQL_NODES) + """, n AS (SELECT id, atan2(pos_y - 60000.0::DOUBLE, pos_x - 130000.0::DOUBLE) AS a FROM nodes WHERE pos_x BETWEEN 20000 AND 250000 AND pos_y IS NOT NULL AND NOT isnan(pos_y)),
        r AS (SELECT heading, a - heading * (pi() / 4) + pi() AS x FROM n, (SELECT unnest(range(8)) AS heading))
        SELECT heading, count(*) AS n FROM r WHERE abs(x - 2 * pi() * floor(x / (2 * pi())) - pi()) <= pi() / 8 GROUP BY 1""",
    "j20_circular_nearest": """WITH t AS (SELECT event_type, (hour(ts) * 60 + minute(ts)) * (2 * pi() / 1440) AS t FROM events), m AS (SELECT event_type, atan2(sum(sin(t)), sum(cos(t))) AS a FROM t GROUP BY 1),
        j AS (SELECT p.event_type, p.a - q.a + pi() AS x FROM m p JOIN m q ON p.event_type <> q.event_type)
        SELECT event_type, min(round(abs(x - 2 * pi() * floor(x / (2 * pi())) - pi()), 6)) AS gap FROM j GROUP BY 1""",
    "j21_nearest_name": sql(SQL_NODES) + """, names AS (SELECT DISTINCT label FROM nodes WHERE label <> '?'), p AS (SELECT label, '^' || lower(label) || '$' AS p FROM names),
        g AS (SELECT DISTINCT label, substr(p, i, 3) AS g FROM (SELECT label, p, unnest(range(1, length(p) - 1)) AS i FROM p)), n AS (SELECT label, count(*) AS n FROM g GROUP BY 1),
        s AS (SELECT a.label AS a, b.label AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.label <> b.label GROUP BY 1, 2),
        q AS (SELECT a, b, round(c / sqrt(CAST(x.n AS DOUBLE) * y.n), 9) AS cos FROM s JOIN n x ON x.label = a JOIN n y ON y.label = b), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS r FROM q)
        SELECT label, b AS nearest, coalesce(cos, 0) AS cos FROM names LEFT JOIN r ON a = label AND r = 1""",
    "l4_nearest_vectors": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS item, round(list_cosine_similarity(a.e, b.e), 12) AS cosine FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, item) AS place FROM s) SELECT query, item, round(cosine, 6) AS cosine, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""",
    "l4_centroids": """WITH x AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label AS t, i, avg(x) AS m FROM x GROUP BY 1, 2),
        l AS (SELECT t, sqrt(sum(m * m)) AS l FROM m GROUP BY 1), dd AS (SELECT vec_id, label, t, sum(x * m) AS d FROM x JOIN m USING (i) GROUP BY 1, 2, 3),
        r AS (SELECT label, t, row_number() OVER (PARTITION BY vec_id ORDER BY round(d / l, 9) DESC, t) AS r FROM dd JOIN l USING (t)) SELECT label, t AS nearest, count(*) AS n FROM r WHERE r = 1 GROUP BY 1, 2""",
    "text_tokens": "WITH " + _WORDS + ", w AS (SELECT doc_id, unnest(list_distinct(t)) AS word FROM toks) SELECT word, count(*) AS n_texts FROM w GROUP BY 1 HAVING count(*) >= 3",
    "c5_keywords": "WITH " + _WORDS + _HITS + " SELECT keyword, category, count(*) AS n_texts, count(*) FILTER (place = 1) AS n_first FROM hits GROUP BY 1, 2",
    "c7_routes": "WITH " + _WORDS + _HITS + " SELECT coalesce(category, 'unknown') AS route, count(*) AS n FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id AND place = 1 GROUP BY 1",
    "g27_products": """WITH q AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS a, CAST(l_linenumber AS INTEGER) AS b FROM lineitem)
        SELECT a, b, a * b AS product, CAST(bit_count(b) AS INTEGER) * 176 AS gates, a + b AS sum, CASE WHEN a >= b THEN a - b END AS difference FROM q""",
    "l14_measured": """WITH n AS (SELECT unnest(range(1, 10)) AS x), p AS (SELECT a.x AS a, b.x AS b FROM n a, n b), c AS (SELECT 'add' AS op, b AS calls FROM p UNION ALL SELECT 'subtract', b FROM p UNION ALL SELECT 'multiply', a * b FROM p UNION ALL SELECT 'divide', a // b * b FROM p)
        SELECT op, count(*) AS n, count(*) AS n_right, CAST(sum(calls) AS BIGINT) AS calls, CAST(max(calls) AS INTEGER) AS most_calls FROM c GROUP BY 1""",
    "text_grams": sql(SQL_NODES) + """, p AS (SELECT '^' || lower(cell_type) || '$' AS p FROM nodes WHERE cell_type IS NOT NULL), g AS (SELECT substr(p, unnest(range(1, length(p) - 2)), 4) AS gram FROM p)
        SELECT gram, count(*) AS n FROM g GROUP BY 1""",
    "json_props": "SELECT event_type, count(json_extract(props, '$.k')) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS total, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS most FROM events GROUP BY 1",
    "l12_controller": """WITH n AS (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS x), p AS (SELECT a.x AS a, b.x AS b FROM n a, n b)
        SELECT a, b, 'add' AS op, a + b AS result, b AS calls FROM p UNION ALL SELECT a, b, 'subtract', CASE WHEN a >= b THEN a - b END, b FROM p
        UNION ALL SELECT a, b, 'multiply', a * b, a * b FROM p UNION ALL SELECT a, b, 'divide', CAST(a // b AS INTEGER), CAST(a // b * b AS INTEGER) FROM p""",
    "l13_sums_in_texts": r"""WITH x AS (SELECT unnest(regexp_extract_all(text, '\b(\d{1,3}) ([-+*/]) (\d{1,3})\b')) AS asked FROM documents), c AS (SELECT asked, count(*) AS n FROM x GROUP BY 1),
        q AS (SELECT asked, n, CAST(string_split(asked, ' ')[1] AS INTEGER) AS a, string_split(asked, ' ')[2] AS op, CAST(string_split(asked, ' ')[3] AS INTEGER) AS b FROM c),
        r AS (SELECT *, CASE op WHEN '+' THEN a + b WHEN '-' THEN a - b WHEN '*' THEN a * b ELSE CASE WHEN b <> 0 THEN a // b END END AS v FROM q)
        SELECT asked, n, CASE WHEN a > 81 OR b > 81 THEN 'operand' WHEN op = '/' AND b = 0 THEN 'zero' WHEN op = '/' AND v >= 50 THEN 'quotient' WHEN v < 0 OR v > 81 THEN 'result' END AS error,
               CASE WHEN a <= 81 AND b <= 81 AND v BETWEEN 0 AND 81 AND NOT (op = '/' AND v >= 50) THEN CAST(v AS INTEGER) END AS result FROM r""",
    "g27_alu": "SELECT DISTINCT CAST(l_quantity AS INTEGER) AS a, l_linenumber AS b, CAST(l_quantity AS INTEGER) + l_linenumber AS s FROM lineitem",
    "l16_energy": sql(SQL_EDGES) + " SELECT np, count(*) AS events, count(DISTINCT pre) * count(DISTINCT post) AS dense, round(count(*) / (count(DISTINCT pre) * count(DISTINCT post)), 6) AS ratio FROM edges GROUP BY 1",
}
