"""Batch product search: token postings, ranked prefix queries, barcode prefixes, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import barcodes
from larder.functions.udfs import fold_text
from larder.operators.matching import spread
from larder.session import durable

# Ranking constants and column weights of the search contract.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
WEIGHTS = {"name": 4.0, "brand": 2.0}
PREFIX_CHARS = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(value: Column) -> Column:
    """Sort key that folds ASCII letters only."""
    return F.translate(value, _UPPER, _LOWER)


def postings(products: DataFrame) -> DataFrame:
    """(gtin, field, token, tf) of names and brands, folded, with diacritics removed."""
    rows = products.select("gtin", F.explode(F.create_map(F.lit("name"), F.col("name"), F.lit("brand"), F.col("brand"))).alias("field", "text"))
    folded = spread(rows.filter("text is not null")).select("gtin", "field", fold_text("text")["norm"].alias("norm"))
    tokens = folded.select("gtin", "field", F.explode(F.split("norm", " ")).alias("token")).filter("token <> ''")
    return tokens.groupBy("gtin", "field", "token").agg(F.count("*").alias("tf"))


def doc_lengths(posts: DataFrame) -> DataFrame:
    return posts.groupBy("gtin").agg(F.sum("tf").alias("doc_len"))


def vocabulary(posts: DataFrame) -> DataFrame:
    """Distinct tokens with the join keys of prefix search: their first one to four characters."""
    words = posts.select("token").distinct()
    widths = F.sequence(F.lit(1), F.least(F.length("token"), F.lit(PREFIX_CHARS)))
    return words.select("token", F.explode(F.transform(widths, lambda n: F.substring("token", F.lit(1), n))).alias("prefix"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, qtoken, times): the folded tokens of each query."""
    norm = queries.select("query_id", fold_text("query")["norm"].alias("norm"))
    tokens = F.filter(F.split("norm", " "), lambda t: t != "")
    return norm.select("query_id", F.explode(tokens).alias("qtoken")).groupBy("query_id", "qtoken").agg(F.count("*").alias("times"))


def text_search(queries: DataFrame, products: DataFrame, posts: DataFrame) -> DataFrame:
    """Ranked page per query (query_id, query, limit, offset): all tokens must match as prefixes.

    Prefixes are resolved on the vocabulary, which is small, so postings are joined on whole tokens;
    a token is scored once however many queries use it, and queries with the same tokens are ranked
    once. The token of a query that fewest products hold leads to its candidates, which the other tokens
    then confirm, so a frequent token beside a rare one costs a row per candidate, not per product.
    Pages are cut by rank, which Spark limits inside each task before the shuffle.
    """
    c = F.col
    posts = durable(posts)
    tokens = query_tokens(queries)
    signature = F.array_sort(F.collect_list(F.struct("qtoken", "times"))).alias("terms")  # the words of one query
    signed = tokens.groupBy("query_id").agg(signature).withColumn("ask", F.sha2(F.to_json("terms"), 256))
    asks = signed.select("ask", "terms").dropDuplicates(["ask"])
    asked = durable(asks.select("ask", F.size("terms").alias("n_terms"), F.inline("terms")))
    needles = asked.select("qtoken").distinct().withColumn("prefix", F.substring("qtoken", 1, PREFIX_CHARS))
    matched = needles.join(vocabulary(posts), "prefix").filter(c("token").startswith(c("qtoken"))).select("qtoken", "token")
    weight = F.coalesce(*(F.when(c("field") == f, F.lit(w)) for f, w in WEIGHTS.items()))
    hits = durable(matched.join(posts, "token").groupBy("qtoken", "gtin").agg(F.sum(c("tf") * weight).alias("freq")))
    df = hits.groupBy("qtoken").agg(F.count("*").alias("df"))
    lengths = doc_lengths(posts)
    stats = lengths.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"))
    n, avg_len = stats.select("n").scalar(), stats.select("avg_len").scalar()
    idf = F.greatest(F.log((n - c("df") + 0.5) / (c("df") + 0.5)), F.lit(MIN_IDF))
    gain = c("freq") * (K1 + 1) / (c("freq") + K1 * (1 - B + B * c("doc_len") / avg_len))
    scored = durable(hits.join(df, "qtoken").join(lengths, "gtin").select("qtoken", "gtin", (idf * gain).alias("score")))
    rarest = asked.join(df, "qtoken", "left").groupBy("ask").agg(
        F.min(F.struct("df", "qtoken"))["qtoken"].alias("lead"), F.count_if(c("df").isNull()).alias("absent")
    )
    led = asked.join(rarest.filter("absent = 0").select("ask", "lead"), "ask")
    first = led.filter("qtoken = lead").select("ask", "n_terms", "qtoken", "times").join(scored, "qtoken")
    first = durable(first.select("ask", "gtin", "n_terms", (c("score") * c("times")).alias("score")))
    others = led.filter("qtoken <> lead").select("ask", "qtoken", "times")
    rest = (
        first.select("ask", "gtin").join(others, "ask").join(scored, ["qtoken", "gtin"])
        .groupBy("ask", "gtin").agg(F.count("*").alias("met"), F.sum(c("score") * c("times")).alias("more_score"))
    )
    whole = first.filter("n_terms > 1").join(rest, ["ask", "gtin"]).filter("met = n_terms - 1")
    rows = (
        first.filter("n_terms = 1").select("ask", "gtin", "score")
        .unionByName(whole.select("ask", "gtin", (c("score") + c("more_score")).alias("score")))
        .join(products.select("gtin", "name", "brand"), "gtin")
    )
    order = [F.desc(F.round("score", 9)), nocase(c("name")), c("gtin")]
    pages = signed.select("query_id", "ask").join(queries.select("query_id", "limit", "offset"), "query_id")
    return cut_pages(rows, pages, "ask", order, "query_id")


def cut_pages(rows: DataFrame, pages: DataFrame, key: str, order: list[Column], page: str | None = None) -> DataFrame:
    """Rows of each page with their rank inside ``key`` and whether more follow; ``page`` names a page (default: the key).

    The deepest page asked for bounds the rank, so each task forwards at most that many rows per key.
    """
    c = F.col
    deepest = pages.agg(F.max(c("offset") + c("limit"))).first()[0] or 0
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(c("rank") <= deepest + 1)
    asked = ranked.join(pages, key).filter((c("rank") > c("offset")) & (c("rank") <= c("offset") + c("limit") + 1))
    more = F.max(c("rank") > c("offset") + c("limit")).over(Window.partitionBy(page or key))
    return asked.withColumn("has_more", more).filter(c("rank") <= c("offset") + c("limit"))


def barcode_search(requests: DataFrame, aliases: DataFrame, products: DataFrame) -> DataFrame:
    """Pages of products whose barcode alias starts with the digits asked for.

    A prefix of length n meets the first n digits of an alias, so the range scan becomes an equi
    join on the digits; an alias has at most 14 of them. Requests for the same digits are ranked once.
    """
    c = F.col
    keys = aliases.select("gtin", "alias", F.explode(F.sequence(F.lit(1), F.length("alias"))).alias("width"))
    keyed = keys.withColumn("prefix", F.substring(c("alias"), F.lit(1), c("width"))).join(
        requests.select("prefix").distinct(), "prefix", "left_semi"
    )
    best = keyed.groupBy("prefix", "gtin").agg(
        F.min(F.when(c("alias") == c("prefix"), 0).otherwise(1)).alias("exact_rank"),
        F.min(F.length("alias")).alias("alias_length"), F.min("alias").alias("best_alias"),
    )
    rows = best.join(products.select("gtin", "name"), "gtin")
    order = [c("exact_rank"), c("alias_length"), c("best_alias"), nocase(c("name")), c("gtin")]
    pages = requests.select("query_id", "prefix", "limit", "offset")
    return cut_pages(rows, pages, "prefix", order, "query_id")


def route(requests: DataFrame, max_query: int | None = None, max_page: int | None = None) -> DataFrame:
    """Where each search request goes: error, empty, barcode (with its digits) or text.

    Long queries and deep pages are errors only where the caller sets a bound.
    """
    c = F.col
    trimmed = requests.withColumn("query", F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), r"[\s\p{Z}]+", " ")))
    coded = barcodes.with_retail_barcode(trimmed, c("query"), F.lit("unknown"), "gtin", "gtin_error")
    digits = F.regexp_replace(F.coalesce("gtin", "query"), r"[\s\p{Z}-]", "")
    numeric = digits.rlike(r"\A[0-9]{1,14}\z")
    kind = (
        F.when(F.length("query") > max_query if max_query is not None else F.lit(False), "error:query-too-long")
        .when((c("limit") < 1) | (c("limit") > max_page if max_page is not None else F.lit(False)), "error:invalid-page-size")
        .when(c("offset") < 0, "error:invalid-offset")
        .when(c("query") == "", "empty").when(numeric, "barcode")
        .when(~c("query").rlike(r"[\p{L}\p{M}\p{N}]"), "empty").otherwise("text")
    )
    return coded.withColumn("route", kind).withColumn("target", F.when(c("route") == "barcode", digits).when(c("route") == "text", c("query")))


def paginate(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """One page in a global order, with ``has_more``: only offset + limit + 1 rows leave the tasks."""
    window = df.orderBy(*order).limit(offset + limit + 1)
    ranked = window.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    more = F.max(F.col("rank") > offset + limit).over(Window.partitionBy(F.lit(1)))
    return ranked.withColumn("has_more", more).filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
