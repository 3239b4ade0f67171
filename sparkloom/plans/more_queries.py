"""Further operators by id: sources (S), projections (F), reports (G), joins (J), ranking (K), sets (U), arrays (V), sampling (P), packing (B), scores (R)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import tokens as T
from sparkloom.operators import groups as G
from sparkloom.operators import metrics as M
from sparkloom.operators import packing
from sparkloom.operators import relational as R
from sparkloom.plans.group_queries import events
from sparkloom.plans.registry import query, table
from sparkloom.plans.token_queries import _PAIRS, pairs
from sparkloom.sources import files


@query("SELECT doc_id, lang FROM documents WHERE doc_id >= 10 AND doc_id < 60")
def s3_row_slice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").where("doc_id >= 10 AND doc_id < 60")


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS distinct_ids FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE false)")
def s5_epoch_cursor(spark, sf):
    """One epoch read from the cursor holds every row once."""
    d = table(spark, sf, "documents").select("doc_id")
    n = d.count()
    rows, _, _ = files.cursor(d, "doc_id", 0, n, seed=1)
    return rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("distinct_ids"))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER () - 1 AS i FROM documents) WHERE i >= 30 AND i < 90")
def s3_file_slice(spark, sf):
    """Also s2: rows by a slice of the path, in the file's order."""
    return files.read_any(spark, f"{sf}/documents.parquet@[30:90]").select("doc_id", "lang")


_EPOCHS = "SELECT doc_id, e AS epoch, row_number() OVER (PARTITION BY e ORDER BY md5((7 + e) || ':' || doc_id), doc_id) - 1 AS place, count(*) OVER (PARTITION BY e) AS n FROM documents, (VALUES (0), (1)) x(e)"


@query(f"SELECT doc_id, epoch, place FROM ({_EPOCHS}) WHERE epoch = 0 AND place >= n - 25 OR epoch = 1 AND place < 40")
def s5_cursor_rows(spark, sf):
    """65 rows from 25 before the end of an epoch on: its tail, and the head of the next one's order."""
    d = table(spark, sf, "documents").select("doc_id")
    rows, _, _ = files.cursor(d, "doc_id", d.count() - 25, 65, seed=7)
    return rows.select("doc_id", "epoch", "place")


@query(f"SELECT doc_id, epoch, place FROM ({_EPOCHS})")
def p1_epoch_places(spark, sf):
    """Every document's place in the orders of two epochs."""
    d = table(spark, sf, "documents").select("doc_id")
    rows, _, _ = files.cursor(d, "doc_id", 0, 2 * d.count(), seed=7)
    return rows.select("doc_id", "epoch", "place")


@query("SELECT item_id AS id, 'buffer' AS origin FROM benchmark UNION ALL (SELECT doc_id, 'source' FROM documents ORDER BY doc_id LIMIT greatest(0, 100 - (SELECT count(*) FROM benchmark)::BIGINT))")
def s7_buffer_first(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("buffer").alias("origin"))
    return files.buffer_first(b, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("source").alias("origin")), "id", max(100, b.count()))


@query("SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 16)")
def s8_evict_oldest(spark, sf):
    return files.evict(table(spark, sf, "benchmark").select("item_id"), "item_id", 16)[1]


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents) WHERE i <= n // 10 // 2 OR i > n - (n // 10 - n // 10 // 2)")
def s23_head_and_tail(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    keep = d.count() // 10
    return d.orderBy("doc_id").limit(keep // 2).unionByName(d.orderBy(F.desc("doc_id")).limit(keep - keep // 2))


@query("SELECT conv_id, min(text) FILTER (turn = 0) AS prompt, count(*) AS turns FROM conversations GROUP BY conv_id")
def s31_first_message(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("prompt"), F.count("*").alias("turns"))


@query("SELECT conv_id, bool_and(role IN ('user', 'assistant', 'system', 'tool')) AS valid FROM conversations GROUP BY conv_id")
def s32_role_check(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return c.select("conv_id", F.forall("roles", lambda r: r.isin("user", "assistant", "system", "tool")).alias("valid"))


@query("SELECT 'documents' AS dataset, count(*) AS n FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'pages', count(*) FROM pages")
def s35_named_datasets(spark, sf):
    return files.merge([table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("dataset"), "n") for t in ("documents", "benchmark", "pages")])


@query("SELECT doc_id, lang || '_' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS id, len(string_split(text, chr(10))) AS num_steps FROM documents")
def f1_registry(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.size(F.split("text", "\n")).cast("long").alias("num_steps"))
    return G.spread_ordinal(d, ["lang"], "doc_id", "i").select("doc_id", F.concat("lang", F.lit("_"), F.col("i").cast("string")).alias("id"), "num_steps")


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'seen' WHEN lang IN ('fr') THEN 'unseen' END AS split FROM documents")
def f3_split_by_type(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("lang").isin("en", "de"), "seen").when(F.col("lang").isin("fr"), "unseen").alias("split"))


@query("SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'en' WHEN contains(url, '/de/') THEN 'de' ELSE 'unknown' END AS split FROM pages")
def f4_split_name(spark, sf):
    parts = F.split(F.lower("url"), "/")
    inner = F.slice(parts, 1, F.size(parts) - 1)
    return table(spark, sf, "pages").select("page_id", F.when(F.array_contains(inner, "en"), "en").when(F.array_contains(inner, "de"), "de").otherwise("unknown").alias("split"))


@query("SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) <= 400")
def f5_length_filter(spark, sf):
    return table(spark, sf, "documents").where(F.size(F.split("text", " ")) <= 400).select("doc_id")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 4 AND count(*) FILTER (trim(text) <> '') >= 4")
def f14_valid_group(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.trim("text") != "").alias("said")).where("n >= 4 AND said >= 4").select("conv_id")


@query("SELECT vec_id, greatest(1, label) AS response_length, 0 AS mask_sum FROM embeddings")
def f18_placeholder(spark, sf):
    mask = F.array_repeat(F.lit(0), F.greatest(F.lit(1), F.col("label")))
    return table(spark, sf, "embeddings").select("vec_id", F.size(mask).alias("response_length"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@query("SELECT event_id, coalesce((props->>'$.k')::DOUBLE, value) AS raw_reward, (event_type = 'signup')::INT AS truncated, CASE WHEN event_type = 'error' THEN 0 ELSE 2 END AS mask_sum FROM events")
def f21_train_rows(spark, sf):
    raw = F.coalesce(F.get_json_object("props", "$.k").cast("double"), "value")
    mask = F.transform(F.array(F.lit(1), F.lit(1)), lambda m: F.when(F.col("event_type") == "error", 0).otherwise(m))
    return table(spark, sf, "events").select("event_id", raw.alias("raw_reward"), (F.col("event_type") == "signup").cast("int").alias("truncated"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@query("SELECT event_id, (props->>'$.k')::BIGINT + 1 AS k FROM events")
def f23_override_merge(spark, sf):
    """The later map wins."""
    own = F.from_json("props", "map<string, bigint>")
    over = F.create_map(F.lit("k"), F.element_at(own, "k") + 1)
    merged = F.map_from_entries(F.concat(F.filter(F.map_entries(own), lambda e: ~F.map_contains_key(over, e["key"])), F.map_entries(over)))
    return table(spark, sf, "events").select("event_id", F.element_at(merged, "k").alias("k"))


@query("SELECT item_id, coalesce(regexp_replace(trim(regexp_extract('  ' || text || chr(34), '^\\s*([^\"\\n]+)', 1)), '[\\s.]+$', ''), '') AS prompt FROM benchmark")
def f26_whole_prompt(spark, sf):
    """f26 with whole texts."""
    text = F.concat(F.lit("intro. Your task is to:  "), F.col("text"), F.lit('" rest'))
    return table(spark, sf, "benchmark").select("item_id", F.coalesce(X.grammar_prompt(text), F.lit("")).alias("prompt"))


@query("SELECT event_id, event_id % 3 = 0 AS solvable FROM events")
def f29_loose_bool(spark, sf):
    word = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, " True ").otherwise("1")).otherwise(F.when(F.col("event_id") % 2 == 0, "no").otherwise("0"))
    return table(spark, sf, "events").select("event_id", X.loose_bool(word).alias("solvable"))


@query("SELECT event_id, 'Doc 1(Title: ' || event_type || ') ' || user_id || chr(10) AS passage FROM events")
def f69_passages(spark, sf):
    rows = F.array(F.struct(F.col("event_type").alias("title"), F.col("user_id").cast("string").alias("text")))
    return table(spark, sf, "events").select("event_id", X.passages(rows).alias("passage"))


@query("SELECT vec_id, CASE WHEN label > 4 THEN 'reward,win_rate,won' ELSE 'reward,win_rate' END AS keys FROM embeddings")
def f78_reward_keys(spark, sf):
    m = F.map_from_arrays(F.array(F.lit("win_rate"), F.lit("step"), F.lit("reward"), F.when(F.col("label") > 4, "won").otherwise("other")), F.array(*[F.lit(1)] * 4))
    keys = F.map_keys(F.map_filter(m, lambda k, v: F.lower(k).rlike("reward|bonus|penalty|score|won|win_rate")))
    return table(spark, sf, "embeddings").select("vec_id", F.array_join(F.array_sort(keys), ",").alias("keys"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS items FROM events GROUP BY user_id")
def g1_group_lists(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("r"))
    return g.select("user_id", F.array_join(F.transform("r", lambda r: r["event_type"]), ",").alias("items"))


_TYPED = "SELECT coalesce(event_type, '*') AS event_type, grouping(event_type)::BIGINT AS level, count(*) AS samples, round(avg({}), 6) AS success FROM events GROUP BY ROLLUP (event_type)"


def _typed(spark, sf, value):
    out = M.rollup_report(table(spark, sf, "events"), ["event_type"], [F.count("*").alias("samples"), F.round(F.avg(value), 6).alias("success")])
    return out.withColumn("event_type", F.coalesce("event_type", F.lit("*")))


@query(_TYPED.format("value"))
def g12_baseline_report(spark, sf):
    return _typed(spark, sf, F.col("value"))


@query("SELECT branch, lang, round(avg(won), 6) AS success FROM (SELECT lang, unnest(['with', 'without']) AS branch, unnest([quality, toxic]) AS won FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
def g13_branch_report(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    both = d.select("lang", F.explode(F.array(F.struct(F.lit("with").alias("branch"), F.col("quality").alias("won")), F.struct(F.lit("without").alias("branch"), F.col("toxic").alias("won")))).alias("b"))
    return both.groupBy("b.branch", "lang").agg(F.round(F.avg("b.won"), 6).alias("success"))


@query(_TYPED.format("(coalesce(CASE WHEN event_type = 'click' THEN true WHEN event_type = 'error' THEN false END, value >= 5))::INT"))
def g16_policy_report(spark, sf):
    """Won: the episode's own mark, else a reward of 5 or more."""
    mark = F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "error", False)
    return _typed(spark, sf, F.coalesce(mark, F.col("value") >= 5).cast("int"))


@query("SELECT round(avg(e - s), 2) AS mean_span, round(1e6 / avg(e - s), 8) AS rate FROM (SELECT min(step) AS a, max(reward) * 1e6 AS e, min(reward) * 1e6 AS s FROM (SELECT *, (step - 1) // 3 AS w FROM (SELECT user_id, value AS reward, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)) GROUP BY user_id, w HAVING count(*) = 3)")
def g42_step_rate(spark, sf):
    from sparkloom.operators.groups import count_windows

    w = count_windows(events(spark, sf), ["user_id"], ["step"], 3).groupBy("user_id", "window_id").agg(((F.max("reward") - F.min("reward")) * 1e6).alias("span"))
    return w.agg(F.round(F.avg("span"), 2).alias("mean_span"), F.round(1e6 / F.avg("span"), 8).alias("rate"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def j1_lookup(spark, sf):
    hit = R.lookup(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey"), F.col("n_nationkey"), ["n_name"])
    return hit.select("c_custkey", F.col("_hit.n_name").alias("n_name"))


@query("SELECT event_id, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS before FROM events")
def j7_step_before(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(-1.0)).alias("before"))


@query("SELECT p_partkey, min(k) AS first_hit FROM part JOIN (SELECT 0 AS k, 'widget' AS w UNION ALL SELECT 1, 'ring' UNION ALL SELECT 2, 'e') ON contains(p_name, w) GROUP BY p_partkey")
def j11_containment(spark, sf):
    """The first of a short fixed list that a text holds."""
    first = F.array_min(F.filter(F.array(*[F.when(F.contains("p_name", F.lit(w)), k) for k, w in enumerate(("widget", "ring", "e"))]), lambda x: x.isNotNull()))
    return table(spark, sf, "part").select("p_partkey", first.alias("first_hit")).where("first_hit IS NOT NULL")


@query("SELECT l_orderkey, row_number() OVER (ORDER BY min(l_shipdate), l_orderkey) AS place FROM lineitem GROUP BY l_orderkey QUALIFY place <= 100")
def k7_sorted_groups(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("t")).orderBy("t", "l_orderkey").limit(100)
    return g.select("l_orderkey", F.row_number().over(Window.orderBy("t", "l_orderkey")).cast("long").alias("place"))  # 100 rows


@query("SELECT doc_id, list_aggregate(list_distinct(string_split(lang || ',' || lang || ',x', ',')), 'count') AS n FROM documents")
def u5_distinct_in_order(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.slice(F.array_distinct(F.split(F.concat("lang", F.lit(","), "lang", F.lit(",x")), ",")), 1, 8)).cast("long").alias("n"))


@query("SELECT conv_id, len(list_distinct(list_concat(list(role), ['tool']))) AS n FROM conversations GROUP BY conv_id")
def u8_set_union(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return c.select("conv_id", F.size(F.array_union("r", F.array(F.lit("tool")))).cast("long").alias("n"))


@query("SELECT vec_id, (label * len(embedding))::BIGINT AS total FROM embeddings")
def v5_spread_reward(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", T.broadcast(F.col("label").cast("long"), F.col("embedding")).alias("r"))
    return e.select("vec_id", F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"SELECT vec_id, round(sum(1 - 0.5 * (a - b)), 6) AS advantage FROM {_PAIRS} GROUP BY vec_id")
def v8_reverse_kl(spark, sf):
    return pairs(spark, sf).select("vec_id", F.round(T.total(F.transform(T.kl(F.col("a"), F.col("b")), lambda k: 1 - 0.5 * k)), 6).alias("advantage"))


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS distinct_ids FROM documents")
def p1_epoch_order(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.xxhash64("doc_id", F.lit(43)).alias("place"))
    return d.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("distinct_ids"))


@query("SELECT doc_id, clone, doc_id * 4 + clone AS sample_index FROM documents, (SELECT unnest(range(4)) AS clone)")
def p2_clones(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("clone")).withColumn("sample_index", F.col("doc_id") * 4 + F.col("clone"))


@query("SELECT item_id, seed FROM benchmark, (SELECT unnest([7, 8, 9])::BIGINT AS seed)")
def p4_repeat_seeds(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.explode(F.sequence(F.lit(7).cast("long"), F.lit(9).cast("long"))).alias("seed"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def b3_cover(spark, sf):
    """Every document is in one part: the parts' sizes add up to the groups'."""
    d = table(spark, sf, "documents").select("source", "lang", F.expr("doc_id div 256").alias("batch"), "doc_id", "n_chars")
    out = packing.balanced(d, ["source", "lang", "batch"], "doc_id", "n_chars", 4)
    return out.groupBy("source", "lang").agg(F.count_distinct("doc_id").alias("n"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 2 % 4 AS rank FROM documents")
def b6_pairs_together(spark, sf):
    d = G.spread_ordinal(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", "i")
    return d.select("doc_id", (F.floor(F.col("i") / 2) % 4).alias("rank"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS micro_batch_id FROM documents")
def b10_batch_ids(spark, sf):
    d = G.spread_ordinal(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", "i")
    return d.select("doc_id", F.floor(F.col("i") / 8).alias("micro_batch_id"))


@query("SELECT user_id % 4 AS region, min_by(user_id, (n, user_id)) AS least_loaded FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) GROUP BY 1")
def b12_least_loaded(spark, sf):
    loads = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return loads.groupBy((F.col("user_id") % 4).alias("region")).agg(F.min_by("user_id", F.struct("n", "user_id")).alias("least_loaded"))


@query("SELECT conv_id, turn, (conv_id + turn) % 4 < 2 AS valid FROM conversations")
def r6_tag_sequence(spark, sf):
    """Thinking, then any number of searches with information, then an answer, with whole texts inside; not with a text between or a search without information."""
    k = (F.col("conv_id") + F.col("turn")) % 4
    search = F.concat(F.lit("<search>"), F.col("role"), F.lit("</search>\n<information>"), F.col("text"), F.lit("</information>"))
    middle = F.when(k == 0, F.concat(search, F.lit("<think>d</think>"))).when(k == 1, " \n").when(k == 2, F.concat(search, F.col("text"))).otherwise("<search>b</search><think>d</think>")
    reply = F.concat(F.lit("<|im_start|>assistant\n<think>"), F.col("text"), F.lit("</think>"), middle, F.lit("<answer>e</answer>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.valid_tag_sequence(reply).alias("valid"))


@query("SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS trained, sum(length(text)) AS n FROM conversations GROUP BY conv_id")
def r21_loss_mask(spark, sf):
    """One mask value for each character: 1 in assistant turns."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("m"))
    mask = F.flatten(F.transform("m", lambda m: F.array_repeat(F.when(m["role"] == "assistant", 1).otherwise(0), m["n"])))
    return c.select("conv_id", mask.alias("k")).select("conv_id", F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x).alias("trained"), F.size("k").cast("long").alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN 0 ELSE 3 END AS mask_sum FROM events")
def x13_stale_mask(spark, sf):
    mask = F.when(F.col("event_type") == "signup", F.array_repeat(F.lit(0), 3)).otherwise(F.array_repeat(F.lit(1), 3))
    return table(spark, sf, "events").select("event_id", F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("mask_sum"))
