"""Keywords of a lexicon found in texts, and the categories they send texts to.

A keyword of one word matches a token that equals it or, from MIN_PREFIX letters on, begins with it, so endings are tolerated; one of
several words matches where it stands in the row of tokens. Tokens meet keywords by equality of their beginnings, which are as many as a
token has letters beyond MIN_PREFIX, so no pair of a token and a foreign keyword is ever made.

Defined cases: null and empty texts have no hits; a keyword counts once a text; an override replaces the category of its keyword, and one
for an unknown keyword adds it; equal lengths go by the alphabet; repeated lexicon rows are one; an empty lexicon finds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonlake.functions.text import folded, tokens

MIN_PREFIX = 4
#: Keywords of several words, each looked for in every text.
MAX_PHRASES = 10_000


def resolved(lexicon: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(keyword, category) of lexicon (word, category), folded, with overrides (word, category) over it."""
    fold = lambda df: df.select(F.trim(F.regexp_replace(folded(F.col("word")), "[^a-z]+", " ")).alias("keyword"), "category").where("keyword != ''").groupBy("keyword").agg(F.min("category").alias("category"))
    if overrides is None:
        return fold(lexicon)
    both = fold(lexicon).join(fold(overrides).withColumnRenamed("category", "own"), "keyword", "full")
    return both.select("keyword", F.coalesce("own", "category").alias("category"))


def hits(texts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, keyword, category, place): the keywords of each text, longest first."""
    words = texts.select(F.col(key), tokens(F.col(text)).alias("__ax_t"))
    single, phrases = lexicon.where("keyword NOT LIKE '% %'"), lexicon.where("keyword LIKE '% %'")
    starts = F.when(F.length("w") > MIN_PREFIX, F.transform(F.sequence(F.lit(MIN_PREFIX), F.length("w") - 1), lambda n: F.substring("w", F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    begun = words.select(key, F.explode(F.array_distinct("__ax_t")).alias("w")).select(key, F.explode(F.concat(F.array("w"), starts)).alias("keyword"))
    found = begun.join(single, "keyword").select(key, "keyword", "category")
    listed = [r["keyword"] for r in phrases.select("keyword").limit(MAX_PHRASES + 1).collect()]
    if len(listed) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} keywords of several words")
    if listed:
        row = F.concat(F.lit(" "), F.array_join("__ax_t", " "), F.lit(" "))
        said = words.withColumn("__ax_row", row).select(key, F.explode(F.filter(F.array(*[F.lit(k) for k in listed]), lambda k: F.col("__ax_row").contains(k))).alias("keyword"))
        found = found.unionByName(said.join(phrases, "keyword").select(key, "keyword", "category"))
    each = found.groupBy(key).agg(F.array_sort(F.collect_set(F.struct((-F.length("keyword")).alias("n"), "keyword", "category"))).alias("h"))  # as many as the lexicon has keywords at most
    return each.select(key, F.posexplode("h").alias("p", "h")).select(key, "h.keyword", "h.category", (F.col("p") + 1).alias("place"))


def routes(texts: DataFrame, key: str, text: str, lexicon: DataFrame, otherwise: str = "unknown") -> DataFrame:
    """(key, route): the category of a text's first keyword."""
    first = hits(texts, key, text, lexicon).where("place = 1").select(key, F.col("category").alias("route"))
    return texts.select(key).join(first, key, "left").select(key, F.coalesce("route", F.lit(otherwise)).alias("route"))
