"""Censuses over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import fields
from lodestrata.operators import census
from lodestrata.plans.registry import query, table

_HEAD = "substr(hex(encode({c})), 1, {n})"
_LABEL = """CASE WHEN octet_length(encode({c})) = 0 THEN 'tag:' WHEN {h} = 'FF3BEF94' THEN 'package' WHEN {h} = '0E4837C3' THEN 'block'
 WHEN {h} = 'E4791207' THEN 'manifest' WHEN {h} = '08000000' THEN 'audio' WHEN {h} = '02000100' THEN 'scene' WHEN {h} = 'F0985030' THEN 'table'
 WHEN regexp_matches({h}, '^([2-6][0-9A-F]|7[0-9A-E])+$') THEN 'tag:' || decode(unhex({h})) ELSE 'UNKNOWN' END""".format(c="text", h="substr(hex(encode(text)), 1, 8)")


@query(
    f"""SELECT label, count(*) AS n, min(id) AS first FROM (
      SELECT doc_id AS id, {_LABEL} AS label FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT page_id, {_LABEL.replace('text', 'html')} FROM pages WHERE html IS NOT NULL) GROUP BY label"""
)
def magic_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode(F.left("text", F.lit(12)), "UTF-8").alias("head"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.encode(F.left("html", F.lit(12)), "UTF-8").alias("head"))
    heads = docs.unionByName(pages).where(F.col("head").isNotNull())
    return census.histogram(heads, fields.classify(F.col("head")), "id")


@query(
    """SELECT label, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, substr(hex(encode(text)), 1, 16) AS label FROM documents)
    GROUP BY label ORDER BY n DESC, first LIMIT 25"""
)
def unknown_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.hex(F.substring(F.encode(F.left("text", F.lit(8)), "UTF-8"), 1, 8))
    return census.histogram(table(spark, sf_dir, "documents"), head, "doc_id", 25)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def largest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.extremes(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 15)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 8")
def smallest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.extremes(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 8, largest=False)


@query("SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.first_example(table(spark, sf_dir, "documents"), "source", "doc_id", "lang", "n_chars")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 40 = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.systematic_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query("SELECT count(*) FILTER (n_chars = length(text)) AS matches, count(*) FILTER (n_chars <> length(text)) AS mismatches FROM documents")
def size_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.col("n_chars") == F.length("text")
    return table(spark, sf_dir, "documents").agg(F.count_if(same).alias("matches"), F.count_if(~same).alias("mismatches"))


@query(
    """SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size), (p_brand, p_type), ())"""
)
def multi_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size")
    b, t, s = F.col("p_brand"), F.col("p_type"), F.col("p_size")
    return part.groupingSets([[b], [t], [s], [b, t], []], b, t, s).agg(F.count("*").alias("n"))


@query(
    """WITH pairs AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
    top AS (SELECT p_brand, sum(n)::BIGINT AS total FROM pairs GROUP BY p_brand ORDER BY total DESC, p_brand LIMIT 12)
    SELECT * FROM (SELECT p_brand, p_type, n, total, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type)::INT AS rank FROM pairs JOIN top USING (p_brand)) WHERE rank <= 4"""
)
def nested_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.nested_top(table(spark, sf_dir, "part"), "p_brand", "p_type", 12, 4).select("p_brand", "p_type", "n", "total", "rank")


@query(
    """SELECT o_orderpriority, count(*) AS blocks, round(avg(o_totalprice / (1 + o_custkey % 7)), 4) AS mean_ratio,
    round(sum(o_totalprice) / sum(1 + o_custkey % 7), 4) AS ratio_of_sums FROM orders GROUP BY 1"""
)
def ratio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = 1 + F.col("o_custkey") % 7
    own = table(spark, sf_dir, "orders").groupBy("o_orderpriority")
    mean, whole = F.avg(F.col("o_totalprice") / n), F.sum("o_totalprice") / F.sum(n)
    return own.agg(F.count("*").alias("blocks"), F.round(mean, 4).alias("mean_ratio"), F.round(whole, 4).alias("ratio_of_sums"))


@query(
    """SELECT byte, count(*) AS n FROM (SELECT unnest(list_transform(range(0, octet_length(encode(text))), lambda i:
    ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::INT)) AS byte FROM benchmark) GROUP BY byte"""
)
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.byte_histogram(table(spark, sf_dir, "benchmark"), F.encode("text", "UTF-8"))


@query(
    """SELECT page_id, ((length(html) - length(replace(html, '<p>', ''))) // 3)::BIGINT AS paragraphs, ((length(html) - length(replace(html, '<a ', ''))) // 3)::BIGINT AS links,
    (strpos(html, '<article>') - 1)::BIGINT AS article_at FROM pages"""
)
def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", census.marker_count(html, "<p>").alias("paragraphs"), census.marker_count(html, "<a ").alias("links"), (F.locate("<article>", html) - 1).cast("bigint").alias("article_at")
    )


@query(
    """SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS segments, round(sum(c_acctbal), 2) AS total, count(*) AS n FROM customer GROUP BY c_nationkey"""
)
def bank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").groupBy("c_nationkey")
    return own.agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.count("*").alias("n"))


@query(
    """SELECT vec_id, round(corr(a, b), 6) AS r FROM (SELECT vec_id, unnest(list_transform(range(1, 33), lambda i: (embedding[2 * i - 1]::DOUBLE + embedding[2 * i]::DOUBLE) / 2)) AS a,
    unnest(list_transform(range(1, 33), lambda i: embedding[i + 16]::DOUBLE)) AS b FROM embeddings) GROUP BY vec_id"""
)
def mip_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of a vector's pair means with its middle half, as a texture's base level is held against its next one."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    pairs = F.arrays_zip(
        F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.get(F.col("e"), 2 * i) + F.get(F.col("e"), 2 * i + 1)) / 2).alias("a"), F.slice("e", 17, 32).alias("b")
    )
    n, sums = F.lit(32.0), F.aggregate(
        pairs,
        F.struct(*[F.lit(0.0).alias(c) for c in ("a", "b", "aa", "bb", "ab")]),
        lambda s, x: F.struct((s["a"] + x["a"]).alias("a"), (s["b"] + x["b"]).alias("b"), (s["aa"] + x["a"] * x["a"]).alias("aa"), (s["bb"] + x["b"] * x["b"]).alias("bb"), (s["ab"] + x["a"] * x["b"]).alias("ab")),
    )  # a row is its own group: no shuffle
    rows = rows.select("vec_id", sums.alias("s"))
    s = F.col("s")
    spread = F.sqrt((n * s["aa"] - s["a"] * s["a"]) * (n * s["bb"] - s["b"] * s["b"]))
    return rows.select("vec_id", F.round((n * s["ab"] - s["a"] * s["b"]) / spread, 6).alias("r"))


