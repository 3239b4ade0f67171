"""Joins (J), top-k (K), set operations (U), filters (F), sampling (P) and packing (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import packing, relational as R, scans
from sparkloom.plans.registry import query, table

_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (greatest(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 1e-12) * greatest(sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 1e-12))"


def _nearest(order: str, k: int, extra: str = "") -> str:
    return f"SELECT query_id, row_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, row_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS row_id, round({_DOT}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 {extra})) WHERE rank <= {k}"


def _queries(spark, sf):
    """The stated query set: every row whose id is divisible by 50, against all rows."""
    e = table(spark, sf, "embeddings")
    return e.where("vec_id % 50 = 0"), e


def _round_score(df):
    return df.select("query_id", "row_id", F.round("score", 5).alias("score"), F.col("rank").cast("long"))


@query(_nearest("DESC", 5))
def j3_nearest_rows(spark, sf):
    """Also k1, k11, m2: exact top-k by cosine."""
    return _round_score(R.top_k(*_queries(spark, sf), 5, "vec_id", "vec_id", "embedding"))


@query(_nearest("ASC", 5))
def k2_farthest_rows(spark, sf):
    return _round_score(R.top_k(*_queries(spark, sf), 5, "vec_id", "vec_id", "embedding", descending=False))


@query(f"SELECT query_id, row_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS row_id, round({_DOT}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE row_id <> query_id) WHERE rank <= 5")
def k3_nearest_others(spark, sf):
    """Also f12: a row's own self is left out before ranking."""
    out = R.top_k(*_queries(spark, sf), 6, "vec_id", "vec_id", "embedding").where("row_id <> query_id")
    from pyspark.sql import Window

    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))).where("rank <= 5")
    return _round_score(ranked)


@query("SELECT doc_id, label_id FROM (SELECT d.doc_id, f.doc_id AS label_id FROM documents d LEFT JOIN (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1) f ON f.k = trim(regexp_replace(d.text, '\\s+', ' ', 'g')))")
def j2_lookup_normalised(spark, sf):
    """Also j1, s19, u3: the first row with the same key."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    k = F.sha2(R.normalised_key("text"), 256)
    firsts = d.groupBy(k.alias("k")).agg(F.min("doc_id").alias("label_id"))
    return d.select("doc_id", k.alias("k")).join(firsts, "k").select("doc_id", "label_id")


@query("SELECT r_regionkey AS k, n_nationkey AS n, i AS r, (r_regionkey * 25 + n_nationkey) * 3 + i AS flat FROM region, nation, (SELECT unnest(range(3)) AS i)")
def j4_fan_out(spark, sf):
    """Also p2, p4: repeats of every combination."""
    out = R.fan_out(table(spark, sf, "region").select(F.col("r_regionkey").alias("k")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("n")), spark.range(3).withColumnRenamed("id", "r"))
    return out.withColumn("flat", ((F.col("k") * 25 + F.col("n")) * 3 + F.col("r")).cast("long"))


@query("WITH k AS (SELECT key FROM (SELECT unnest(list_transform(range(1, length(p_name) + 1), lambda i: left(p_name, i))) AS key FROM part) GROUP BY key HAVING count(*) > 1) SELECT p_partkey, max_by(key, length(key)) AS prefix FROM part LEFT JOIN k ON starts_with(p_name, key) GROUP BY p_partkey")
def j5_longest_shared_prefix(spark, sf):
    """j5 with keys from all parts and of all lengths: what at least two names start with. Every part has a row."""
    return R.longest_shared_prefix(table(spark, sf, "part"), "p_partkey", "p_name", "prefix")


@query("SELECT conv_id, coalesce(max(CASE WHEN role = 'user' THEN length(text) END), -1) AS with_user, coalesce(max(CASE WHEN role = 'assistant' THEN length(text) END), -1) AS with_assistant FROM conversations GROUP BY conv_id")
def j8_paired_branches(spark, sf):
    n = F.length("text")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(*[F.coalesce(F.max(F.when(F.col("role") == r, n)), F.lit(-1)).alias(f"with_{r}") for r in ("user", "assistant")])


@query("SELECT vec_id, round(sum(x * y), 6) AS zipped FROM (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) GROUP BY vec_id")
def j10_zip(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(R.dot(F.col("embedding"), F.col("other")), 6).alias("zipped"))


@query("SELECT l_orderkey, string_agg(p_name, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def j12_fetch_and_regroup(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    joined = li.join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name")))
    return joined.groupBy("l_orderkey").agg(rows.alias("rows")).select("l_orderkey", F.array_join(F.transform("rows", lambda r: r["p_name"]), ",").alias("parts"))


@query("WITH g AS (SELECT user_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 10) SELECT event_id, user_id FROM events SEMI JOIN g USING (user_id)")
def k5_newest_groups(spark, sf):
    e = table(spark, sf, "events")
    latest = e.groupBy("user_id").agg(F.max("ts").alias("t")).orderBy(F.desc("t"), "user_id").limit(10)
    return e.join(latest, "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 30")
def k6_largest(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(30)


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 ORDER BY min(l_shipdate), l_orderkey LIMIT 64")
def k13_first_groups(spark, sf):
    """Also k7, x1: the first complete groups, in order of completion."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("t")).where("n > 1")
    return g.orderBy("t", "l_orderkey").limit(64).select("l_orderkey")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= n // 64 * 64")
def k8_trim_to_batches(spark, sf):
    """The rows beyond the last whole batch are fewer than a batch: they are found by a bounded limit, not by numbering all rows."""
    d = table(spark, sf, "documents").select("doc_id")
    rest = d.count() % 64
    return d.join(d.orderBy(F.desc("doc_id")).limit(rest), "doc_id", "left_anti")


_BM25 = """WITH tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\W+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL), l AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id), t AS (SELECT count(*) AS n, avg(len) AS a FROM l), d AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '\\W+')) AS w FROM benchmark) WHERE w <> ''), s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / a))), 9) AS score FROM q JOIN tf USING (w) JOIN d USING (w) JOIN l USING (doc_id), t GROUP BY ALL)
SELECT item_id, doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3"""


@query(_BM25)
def k10_bm25(spark, sf):
    """Also s26: passages of the benchmark as queries over all documents."""
    out = R.bm25(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text"), 3, "doc_id", "item_id", "text")
    return out.select("item_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long"))


@query("SELECT l_orderkey, round(stddev_samp(l_discount), 6) AS std FROM lineitem GROUP BY l_orderkey HAVING stddev_samp(l_discount) > 1e-6")
def f6_spread_filter(spark, sf):
    """Also f14, h5: groups whose rewards differ; a group of one has no spread."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.stddev_samp("l_discount").alias("std")).where("std > 1e-6").withColumn("std", F.round("std", 6))


@query("SELECT l_suppkey, round(avg((l_returnflag = 'R')::INT), 6) AS rate, avg((l_returnflag = 'R')::INT) <= 0.35 AS kept FROM lineitem GROUP BY l_suppkey")
def f9_mean_success_filter(spark, sf):
    out = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("rate"))
    return out.select("l_suppkey", F.round("rate", 6).alias("rate"), (F.col("rate") <= 0.35).alias("kept"))


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) FILTER (value > 10) / count(*) AS p, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS k FROM c), t AS (SELECT user_id, max(p) FILTER (k = 1) AS p1, max(n) FILTER (k = 1) AS n1, max(p) FILTER (k = 2) AS p2, max(n) FILTER (k = 2) AS n2 FROM r GROUP BY user_id)
    SELECT user_id, round((p1 - p2) / (sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) + 1e-8), 4) AS z, coalesce((p1 - p2) / (sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) + 1e-8) >= 1, true) AS keep FROM t"""
)
def f10_margin_filter(spark, sf):
    """Also n19."""
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg((F.count_if(F.col("value") > 10) / F.count("*")).alias("p"), F.count("*").alias("n"))
    return R.margin_filter(c, ["user_id"], "event_type", "p", "n").select("user_id", F.round("z", 4).alias("z"), "keep")


@query("SELECT vec_id, CASE WHEN label = 0 THEN 'extractor' WHEN label >= 1 THEN 'solver' END AS role FROM embeddings")
def f16_role_split(spark, sf):
    """Also f3, f17."""
    return table(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") == 0, "extractor").when(F.col("label") >= 1, "solver").alias("role"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'aborted' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'truncated' ELSE 'pending' END AS status FROM events")
def f19_status(spark, sf):
    e = F.col("event_type")
    return table(spark, sf, "events").select("event_id", F.when(e == "error", "aborted").when(e == "purchase", "completed").when(e == "signup", "truncated").otherwise("pending").alias("status"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce((props->>'$.missing')::BIGINT, -1) AS missing FROM events")
def f20_reward_by_key(spark, sf):
    """Also f67, f78, f79."""
    v = lambda k: F.get_json_object("props", f"$.{k}").cast("long")
    return table(spark, sf, "events").select("event_id", v("k").alias("k"), F.coalesce(v("missing"), F.lit(-1)).alias("missing"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn > user_id % 5")
def f77_counted_skip(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.where(F.col("rn") > F.col("user_id") % 5).select("user_id", "event_id")


@query("SELECT 'c' AS side, c_custkey AS k, c_nationkey AS n FROM customer UNION ALL SELECT 's', s_suppkey, s_nationkey FROM supplier")
def u1_union_all(spark, sf):
    """Also u2, s15."""
    c = table(spark, sf, "customer").select(F.lit("c").alias("side"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    return c.unionByName(table(spark, sf, "supplier").select(F.lit("s").alias("side"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")))


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def u3_keep_first(spark, sf):
    return R.keep_first(table(spark, sf, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"]).select("source", "lang", "doc_id")


@query("SELECT DISTINCT source FROM documents")
def u4_distinct(spark, sf):
    return table(spark, sf, "documents").select("source").distinct()


@query("WITH t AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) GROUP BY ALL) SELECT a.item_id, sum(least(a.n, b.n))::BIGINT AS overlap FROM t a JOIN t b ON a.w = b.w AND b.item_id = a.item_id + 1 GROUP BY a.item_id")
def u6_multiset_overlap(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v")), "item_id")
    return pairs.select("item_id", R.multiset_overlap(F.col("w"), F.col("v")).cast("long").alias("overlap")).where("overlap > 0")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def u7_difference(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, doc_id % 8 AS rank FROM documents")
def b5_strided(spark, sf):
    """Also b7, s24: the rank is a partition column of the sink."""
    return table(spark, sf, "documents").select("doc_id", F.pmod("doc_id", F.lit(8)).alias("rank"))


@query("SELECT greatest(count(*) // 8 * 8, 8) AS batch FROM documents")
def b8_batch_size(spark, sf):
    return table(spark, sf, "documents").agg(F.greatest(F.floor(F.count("*") / 8) * 8, F.lit(8)).cast("long").alias("batch"))


def batches(spark, sf):
    """Documents with their training batch: 256 neighbours by id, so a group is bounded."""
    return table(spark, sf, "documents").select(F.expr("doc_id div 256").alias("batch"), "doc_id", "n_chars")


@query()
def b1_first_fit(spark, sf):
    """Bins of capacity 40,000 for the documents of each training batch, in order of id."""
    return packing.first_fit(batches(spark, sf), ["batch"], "doc_id", "n_chars", 40000)


@query()
def b2_balanced_partitions(spark, sf):
    """Four parts of nearly equal total length for each training batch, by largest differencing."""
    return packing.balanced(batches(spark, sf), ["batch"], "doc_id", "n_chars", 4)


@query("WITH RECURSIVE d AS (SELECT lang, doc_id, n_chars AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents), c(lang, doc_id, i, chunk, total) AS (SELECT lang, doc_id, i, 0, n FROM d WHERE i = 1 UNION ALL SELECT d.lang, d.doc_id, d.i, CASE WHEN c.total >= 20000 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.total >= 20000 THEN 0 ELSE c.total END + d.n FROM c JOIN d ON d.lang = c.lang AND d.i = c.i + 1) SELECT lang, doc_id, chunk FROM c")
def b11_chunks(spark, sf):
    """Chunks of each language's documents, in order of id, that close once their length reaches 20,000: by pointers, so a language of any size."""
    return scans.chunks(table(spark, sf, "documents").select("lang", "doc_id", "n_chars"), ["lang"], "doc_id", "n_chars", 20000).select("lang", "doc_id", "chunk")
