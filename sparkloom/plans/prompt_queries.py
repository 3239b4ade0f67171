"""Prompts (F34, F41) and the vector cache (S17-S19) over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloom.functions import cards, compaction, prompts
from sparkloom.functions import text as X
from sparkloom.operators import packing, pages
from sparkloom.plans.registry import query, table
from sparkloom.plans.relational_queries import batches
from sparkloom.sources import files, vectors
from sparkloom.sources.shared import shared_dir


@query(
    r"""WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, ' of ', ' <image> ', 'g'), ' and ', '<video>', 'g') AS t FROM conversations),
    n AS (SELECT conv_id, sum((length(t) - length(replace(t, '<image>', ''))) // 7)::BIGINT AS images, sum((length(t) - length(replace(t, '<video>', ''))) // 7)::BIGINT AS videos, md5(string_agg(regexp_replace(t, '<image>|<video>', '#', 'g'), '|' ORDER BY turn)) AS said FROM c GROUP BY conv_id)
    SELECT conv_id, images, videos, said, CASE WHEN conv_id % 3 = 1 THEN '1 image left over' WHEN conv_id % 3 = 2 AND videos > 0 THEN '1 video missing' END AS error FROM n"""
)
def f34_placeholders(spark, sf):
    """Words of all turns as placeholders; a third of the conversations has an image too many, a third a video too few. The filled parts, read in order, give the turns again."""
    text = F.regexp_replace(F.regexp_replace("text", " of ", " <image> "), " and ", "<video>")
    c = table(spark, sf, "conversations").withColumn("content", text).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    count = lambda p: F.aggregate("m", F.lit(0), lambda a, m: a + F.size(F.split(m["content"], p, -1)) - 1)
    c = c.select("conv_id", "m", count("<image>").alias("images"), count("<video>").alias("videos"))
    items = lambda kind, n: F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), lambda i: F.when(i < n, F.concat(F.lit(kind), i.cast("string")))), lambda x: x.isNotNull())
    c = c.withColumn("pictures", items("i", F.col("images") + F.when(F.col("conv_id") % 3 == 1, 1).otherwise(0))).withColumn("films", items("v", F.col("videos") - F.when(F.col("conv_id") % 3 == 2, 1).otherwise(0)))
    filled = c.withColumn("f", prompts.fill_placeholders(F.col("m"), {"<image>": ("image", F.col("pictures")), "<video>": ("video", F.col("films"))}))
    kinds = F.flatten(F.transform("f.messages", lambda m: F.transform(m["content"], lambda p: p["kind"])))
    turn = lambda m: F.array_join(F.transform(m["content"], lambda p: F.when(p["kind"] == "text", p["value"]).otherwise("#")), "")
    of = lambda kind: F.size(F.filter(kinds, lambda k: k == kind)).cast("long")
    return filled.select("conv_id", of("image").alias("images"), of("video").alias("videos"), F.md5(F.array_join(F.transform("f.messages", turn), "|")).alias("said"), F.col("f.error").alias("error"))


@query(r"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(CASE WHEN turn % 3 = 2 THEN text ELSE text || chr(10) || chr(10) || 'Then ' || role END, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ')) AS text FROM conversations")
def f41_without_lists(spark, sf):
    """Lists of actions with lists inside, over several lines, taken out of whole turns; every third turn has none."""
    listed = F.concat("text", F.lit("\n Admissible actions: [look,\n [go, [to]], use] \t\r\n\n"), F.lit("Then "), "role", F.lit("  \n\n\n"))
    text = F.when(F.col("turn") % 3 == 2, F.col("text")).otherwise(listed)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(prompts.without_lists(text)).alias("text"))


@query(
    """SELECT 1 AS run, count(*) AS added FROM (SELECT DISTINCT lang, text FROM documents WHERE lang <> 'en') UNION ALL SELECT 2, count(*) FROM (SELECT DISTINCT lang, text FROM documents WHERE lang = 'en')
    UNION ALL SELECT 3, 0 UNION ALL SELECT 4, count(*) FROM (SELECT DISTINCT lang, text FROM documents WHERE length(text) % 10 = 0)"""
)
def s17_vector_cache(spark, sf):
    """Also s18: what each run adds: some documents, all of them, all again, all with a tenth changed."""
    d = table(spark, sf, "documents").select("lang", "text")
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    changed = d.withColumn("text", F.when(F.length("text") % 10 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    added = [(k, vectors.build(rows, path, "lang", "text")) for k, rows in enumerate((d.where("lang <> 'en'"), d, d, changed), 1)]
    return spark.createDataFrame(added, "run int, added long")


@query("SELECT doc_id, 64 AS n, CASE WHEN regexp_matches(text, '\\S') THEN 1.0 ELSE 0.0 END AS norm FROM documents")
def s19_cached_vectors(spark, sf):
    """Every document finds its vector in the cache."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    vectors.build(d, path, "lang", "text")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return vectors.match(d, path, "lang", "text").select("doc_id", F.size("vector").alias("n"), F.round(norm, 4).alias("norm"))


#: A page of each brand's parts, one line each; steps 0 and 1 show it, their actions name two parts, and a third is expected.
_LINES = "SELECT p_brand, p_partkey, '- ' || p_type || ' \"' || p_name || '\" [ref=e' || p_partkey || ']' AS line, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part"


@query(
    f"""WITH l AS ({_LINES}), r AS (SELECT p_brand, min(p_partkey) AS low, max(p_partkey) AS high FROM part GROUP BY p_brand), a AS (SELECT p_brand, s, low + 25 * (s + 1) AS k FROM r, (VALUES (0), (1)) x(s) UNION ALL SELECT p_brand, 1, high FROM r),
    t AS (SELECT l.*, s, EXISTS (SELECT 1 FROM a JOIN l h ON h.p_brand = a.p_brand AND h.p_partkey = a.k WHERE a.p_brand = l.p_brand AND a.s = x.s AND abs(h.i - l.i) <= 5) AS near FROM l, (VALUES (0), (1)) x(s)),
    k AS (SELECT *, max(near::INT) OVER (PARTITION BY p_brand, s) AS any_near FROM t), m AS (SELECT *, i - lag(i) OVER (PARTITION BY p_brand, s ORDER BY i) - 1 AS skipped FROM k WHERE near OR any_near = 0),
    p AS (SELECT p_brand, s, string_agg(CASE WHEN skipped > 0 THEN '- ... omitted ' || skipped || ' unrelated elements ...' || chr(10) ELSE '' END || line, chr(10) ORDER BY i) AS page FROM m GROUP BY p_brand, s),
    b AS (SELECT p_brand, s, chr(10) || chr(10) || '[Step ' || s || ']' || chr(10) || 'Current page snapshot (source=x):' || chr(10) || page || chr(10) || chr(10) || 'Previous actions:' || chr(10) || '<action>CLICK e' || (low + 25 * (s + 1)) || '</action>' AS block FROM p JOIN r USING (p_brand))
    SELECT p_brand, md5('Task' || string_agg(block, '' ORDER BY s)) AS text FROM b GROUP BY p_brand"""
)
def f58_compacted_steps(spark, sf):
    """Also f56, f57: trajectories of two steps over a brand's page, cut to the lines around what is named and what is expected."""
    line = F.concat(F.lit("- "), "p_type", F.lit(' "'), "p_name", F.lit('" [ref=e'), "p_partkey", F.lit("]"))
    page = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("l"), F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))
    shown = F.array_join("l.line", "\n")
    step = lambda s: F.concat(F.lit(f"\n\n[Step {s}]\nCurrent page snapshot (source=x):\n"), shown, F.lit("\n\nPrevious actions:\n<action>CLICK e"), (F.col("low") + 25 * (s + 1)).cast("string"), F.lit("</action>"))
    text = F.concat(F.lit("Task"), step(0), step(1))
    expected = F.create_map(F.lit(1), F.array(F.concat(F.lit("e"), F.col("high").cast("string"))))
    return page.select("p_brand", F.md5(compaction.compact_long(text, F.length(text), expected, limit=0)).alias("text"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 IN (3, 4) THEN NULL ELSE md5('# Skill: ' || event_type || chr(10) || chr(10) || 'User ' || user_id || CASE WHEN event_id % 5 = 1 THEN chr(10) || chr(10) || '**Category**: ' || event_type || ' | **Signal**: ' || user_id || chr(10) || chr(10) || '## Overview' || chr(10) || '- ' || event_type || chr(10) || '- two' || chr(10) || chr(10) || '## Workflow' || chr(10) || '1. **' || event_type || '**: go' || chr(10) || '   - Done when: ' || user_id ELSE '' END) END AS card,
    CASE event_id % 5 WHEN 3 THEN 'Missing required fields: description' WHEN 4 THEN 'Invalid JSON' ELSE '' END AS error, CASE WHEN event_id % 5 < 3 THEN 1 ELSE 0 END AS score FROM events"""
)
def f39_cards(spark, sf):
    """Also f40: replies with prose around their JSON: plain, with sections, with a lesser object before, without a field, and cut off."""
    k, user = F.col("event_id") % 5, F.col("user_id").cast("string")
    name, said = F.col("event_type").alias("name"), F.concat(F.lit("User "), user).alias("description")
    plain = F.to_json(F.struct(name, said))
    step = F.struct(F.lit(1).alias("step"), F.col("event_type").alias("goal"), F.lit("go").alias("action"), user.alias("completion_condition"))
    meta = F.struct(F.col("event_type").alias("skill_category"), user.alias("success_signal"))
    full = F.to_json(F.struct(name, said, meta.alias("metadata"), F.array("event_type", F.lit("two")).alias("skill_overview"), F.array(step).alias("workflow")))
    reply = F.when(k == 0, plain).when(k == 1, F.concat(F.lit("So:\n```json\n"), full, F.lit("\n```"))).when(k == 2, F.concat(F.lit('{"x": 1} and '), plain, F.lit(" done }"))).when(k == 3, F.to_json(F.struct(name, F.lit("").alias("description")))).otherwise(F.concat(F.lit("cut "), F.substring(plain, 1, 15)))
    out = table(spark, sf, "events").select("event_id", reply.alias("reply")).withColumn("c", cards.card(F.col("reply")))
    return out.select("event_id", F.md5("c.card").alias("card"), F.col("c.error").alias("error"), cards.format_verdict(F.col("reply"))["score"].alias("score"))


@query()
def f52_outlines(spark, sf):
    """The outline of each page: 64 elements and 2,000 characters at most, as the operator defines it."""
    return table(spark, sf, "pages").select("page_id", pages.outline(F.col("html")).alias("outline"))


@query(
    """SELECT conv_id, turn, CASE WHEN k IN (0, 1) THEN 'CLICK' WHEN k = 2 THEN 'TYPE' ELSE '' END AS op, CASE WHEN k < 3 THEN 'e' || conv_id ELSE '' END AS ref,
    CASE k WHEN 0 THEN '' WHEN 3 THEN 'look at e1' WHEN 4 THEN trim(regexp_replace(right(text, 200), '\\s+', ' ', 'g')) ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS value, k < 3 AS valid FROM (SELECT *, (conv_id + turn) % 5 AS k FROM conversations)"""
)
def f43_web_action(spark, sf):
    """Actions in tags with whole turns as values, tags without an action, and turns without a tag."""
    k, ref = (F.col("conv_id") + F.col("turn")) % 5, F.concat(F.lit("e"), "conv_id")
    said = F.when(k == 0, F.concat(F.lit("hover "), ref)).when(k == 1, F.concat(F.lit("\n Click "), ref, F.lit(": "), "text")).when(k == 2, F.concat(F.lit("TYPE "), ref, F.lit(" | "), "text")).otherwise("look at e1")
    text = F.when(k == 4, F.col("text")).otherwise(F.concat(F.lit("Hm. <ACTION>"), said, F.lit("</action> <action>CLICK e0</action>")))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.web_action(text).alias("a")).select("conv_id", "turn", "a.*")


@query("SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) END AS only, md5(string_agg(chr(39) || event_type || chr(39), ',' || chr(10) || ' ' ORDER BY event_id) FILTER (event_type <> 'error')) AS listed FROM events GROUP BY user_id HAVING count(*) FILTER (event_type <> 'error') > 0")
def f64_admissible(spark, sf):
    """Lists of one unwrapped, and lists as text without what does nothing."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type")))["event_type"].alias("t"))
    out = e.select("user_id", X.unwrapped(F.col("t")).alias("only"), X.admissible(F.col("t"), "error").alias("listed"))
    return out.where("listed <> ''").select("user_id", "only", F.md5("listed").alias("listed"))


@query("SELECT doc_id FROM documents WHERE left(md5('3:' || doc_id), 1) = '0'")
def p3_log_sample(spark, sf):
    """One row in sixteen for the log, by a digest of its id, so that every run shows the same."""
    return table(spark, sf, "documents").select("doc_id").where(F.left(F.md5(F.concat(F.lit("3:"), F.col("doc_id").cast("string"))), F.lit(1)) == "0")


@query("SELECT count(*) - 25 AS \"offset\", 0::BIGINT AS epoch, 7 AS rollout FROM documents UNION ALL SELECT 40, 1, 8 FROM documents WHERE doc_id = 0")
def s6_source_state(spark, sf):
    """A cursor's places kept after two rollouts, the first of them twice, and read again."""
    n, path = table(spark, sf, "documents").count(), f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    for rollout, offset, epoch in ((7, 1, 1), (8, 40, 1), (7, n - 25, 0)):
        files.save_state(spark, path, rollout, offset=offset, epoch=epoch)
    kept = [files.load_state(spark, path, 7), files.load_state(spark, path)]
    return spark.createDataFrame([(r["offset"], r["epoch"], int(r["rollout"])) for r in kept], "offset long, epoch long, rollout int")


@query()
def b4_greedy_parts(spark, sf):
    """Four parts of each training batch, the longest documents first, each to the least part."""
    return packing.greedily(batches(spark, sf), ["batch"], "doc_id", "n_chars", 4)
