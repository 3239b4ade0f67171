"""More operators by id: filters and projections (F), ranking (K), vectors (M), runs and scans (N), scores (R), sources (S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.plans.registry import query, table

#: Turns of a line filter's window on both sides of a hit.
AROUND = 5


@query("SELECT e.event_id, e.user_id, g.keep, CASE WHEN g.keep THEN '' ELSE 'zero_spread' END AS reason FROM events e JOIN (SELECT user_id, event_type, coalesce(stddev_samp(value) > 25, false) AS keep FROM events GROUP BY ALL) g USING (user_id, event_type)")
def f11_group_verdict(spark, sf):
    """A group's filter verdict and reason on every one of its rows."""
    e = table(spark, sf, "events")
    verdict = e.groupBy("user_id", "event_type").agg(F.coalesce(F.stddev_samp("value") > 25, F.lit(False)).alias("keep"))
    return e.join(verdict, ["user_id", "event_type"]).select("event_id", "user_id", "keep", F.when(F.col("keep"), "").otherwise("zero_spread").alias("reason"))


@query("SELECT page_id, length(regexp_extract(url, '^[a-z]+://[^/?#]+', 0)) AS host_chars, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '(\\.[A-Za-z0-9]+)$', 1) IN ('', '.html', '.htm', '.shtml') AS keep FROM pages")
def f15_link_filter(spark, sf):
    """Links whose path ends in no extension or in that of a page."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", F.length(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0)).cast("long").alias("host_chars"), F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1).isin("", ".html", ".htm", ".shtml").alias("keep"))


@query(
    """SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN 0.0 WHEN ends AND long_enough THEN 0.0 WHEN ends OR long_enough THEN -0.5 ELSE -1.0 END AS penalty, CASE WHEN role = 'assistant' AND ends AND long_enough THEN 1 ELSE 0 END AS score
    FROM (SELECT *, right(rtrim(text), 1) IN ('.', '!', '?') AS ends, length(text) >= 200 AS long_enough FROM conversations)"""
)
def f40_format_verdict(spark, sf):
    """A penalty for each part of the format that a reply misses, and a score if it misses none."""
    ends, long_enough = F.right(F.rtrim("text"), F.lit(1)).isin(".", "!", "?"), F.length("text") >= 200
    reply = F.col("role") == "assistant"
    missed = (F.when(ends, 0.0).otherwise(0.5) + F.when(long_enough, 0.0).otherwise(0.5)).cast("double")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(reply & (missed > 0), -missed).otherwise(0.0).alias("penalty"), F.when(reply & (missed == 0), 1).otherwise(0).alias("score"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
    h AS (SELECT *, max(CASE WHEN contains(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {AROUND} PRECEDING AND {AROUND} FOLLOWING) AS keep FROM l)
    SELECT doc_id, count(*) AS n_lines, CAST(sum(keep) AS BIGINT) AS n_kept, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep = 1), '')) AS kept FROM h GROUP BY doc_id"""
)
def f57_lines_around_hits(spark, sf):
    """The lines up to AROUND before and behind a hit; the window runs inside a text."""
    lines = F.split("text", "\n")
    hits = F.transform(lines, lambda x: x.contains("#"))
    near = lambda i: F.exists(F.slice("hits", F.greatest(i - AROUND + 1, F.lit(1)), F.lit(AROUND + 1) + F.least(i, F.lit(AROUND))), lambda h: h)
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", lines.alias("lines"), hits.alias("hits"))
    kept = d.select("doc_id", "lines", F.filter("lines", lambda x, i: near(i)).alias("kept"))
    return kept.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"), F.md5(F.array_join("kept", "\n")).alias("kept"))


@query("SELECT doc_id, length(text) > 2000 AS cut, md5(CASE WHEN length(text) > 2000 THEN left(text, 1000) || ' ... ' || right(text, 1000) ELSE text END) AS text FROM documents WHERE text IS NOT NULL")
def f58_compaction(spark, sf):
    """Texts beyond a length keep their head and tail. The cut is what this operator is for."""
    cut = F.length("text") > 2000
    short = F.when(cut, F.concat(F.left("text", F.lit(1000)), F.lit(" ... "), F.right("text", F.lit(1000)))).otherwise(F.col("text"))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", cut.alias("cut"), F.md5(short).alias("text"))


@query("SELECT event_id, CASE WHEN value > 50 THEN round(ln(value - 50), 6) END AS clean, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def f66_clean_numbers(spark, sf):
    """Numbers that are none become null, times ISO strings."""
    raw = F.when(F.col("value") > 50, F.round(F.log(F.col("value") - 50), 6)).otherwise(F.lit(float("nan")))
    plain = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return table(spark, sf, "events").select("event_id", plain(raw).alias("clean"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("SELECT user_id, least(count(*), 20) AS n, md5(string_agg(event_id::VARCHAR, ',' ORDER BY r) FILTER (r <= 20)) AS ids, round(sum(value) FILTER (r <= 20), 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY user_id")
def k9_trim_parallel_lists(spark, sf):
    """Parallel lists of a group, all cut to the same kept length: ranked first, so that every task passes on no more of a group than is kept."""
    ranked = table(spark, sf, "events").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("rank <= 20")
    lists = ranked.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("rows"))
    cut = lists.select("user_id", F.col("rows.event_id").alias("ids"), F.col("rows.value").alias("values"))
    return cut.select("user_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(embedding[1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12), 5) AS first FROM embeddings")
def m2_unit_vectors(spark, sf):
    """Vectors of length one; the norm is 1e-12 at least."""
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.sqrt(squares).alias("norm"))
    unit = F.transform("embedding", lambda x: x.cast("double") / F.greatest(F.col("norm"), F.lit(1e-12)))
    return e.select("vec_id", F.round("norm", 5).alias("norm"), F.round(F.get(unit, F.lit(0)), 5).alias("first"))


@query("SELECT event_id, 'rollout/k' AS name, (props->>'$.k')::BIGINT AS value FROM events WHERE props->>'$.k' IS NOT NULL")
def m7_prefix_keys(spark, sf):
    """All keys of a map get a prefix."""
    renamed = F.transform_keys(F.from_json("props", "map<string, bigint>"), lambda k, v: F.concat(F.lit("rollout/"), k))
    return table(spark, sf, "events").select("event_id", F.explode(renamed).alias("name", "value"))


@query(
    """WITH p AS (SELECT a.vec_id, a.embedding AS r, b.embedding AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), d AS (SELECT vec_id, i, r[i]::DOUBLE + 0.99 * coalesce(v[i + 1]::DOUBLE, 0) - v[i]::DOUBLE AS delta FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM p))
    SELECT vec_id, round(sum(delta * pow(0.99 * 0.95, i - 1)), 6) AS advantage0, round(sum(delta * pow(0.99 * 0.95, i - 21)) FILTER (i >= 21), 6) AS advantage20 FROM d GROUP BY vec_id"""
)
def n18_chunked_scan(spark, sf):
    """The reverse recurrence of advantages by chunks of 16: each chunk by itself, then what the next chunk begins with comes in with its decay."""
    chunk, decay = 16, 0.99 * 0.95
    v = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("r"))
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("r").alias("v")), "vec_id")
    delta = F.transform("r", lambda x, i: x + 0.99 * F.coalesce(F.get("v", i + 1), F.lit(0.0)) - F.get("v", i))
    starts = F.sequence(F.lit(0), F.size("r") - 1, F.lit(chunk))
    back = lambda xs: F.aggregate(F.reverse(xs), F.array().cast("array<double>"), lambda a, x: F.concat(F.array(x + decay * F.coalesce(F.get(a, F.lit(0)), F.lit(0.0))), a))
    d = p.select("vec_id", delta.alias("d"), starts.alias("starts"))
    alone = d.select("vec_id", F.transform("starts", lambda s: back(F.slice("d", s + 1, F.lit(chunk)))).alias("alone"))
    lift = lambda xs, carry: F.transform(xs, lambda x, i: x + F.pow(F.lit(decay), F.size(xs) - i) * carry)
    joined = F.aggregate(F.reverse("alone"), F.array().cast("array<double>"), lambda a, xs: F.concat(lift(xs, F.coalesce(F.get(a, F.lit(0)), F.lit(0.0))), a))
    out = alone.select("vec_id", joined.alias("g"))
    return out.select("vec_id", F.round(F.get("g", F.lit(0)), 6).alias("advantage0"), F.round(F.get("g", F.lit(20)), 6).alias("advantage20"))


@query(
    """SELECT conv_id, turn, role AS rm_type, CASE role WHEN 'assistant' THEN CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0.0 END WHEN 'user' THEN CASE WHEN length(text) <= 300 THEN 1.0 ELSE 0.0 END ELSE 0.0 END AS score FROM conversations"""
)
def r1_dispatch(spark, sf):
    """Scorers by the row's own kind, the default for all others."""
    scorers = {"assistant": F.lower("text").contains("the"), "user": F.length("text") <= 300}
    score = F.lit(0.0)
    for kind, right in scorers.items():
        score = F.when(F.col("role") == kind, F.when(right, 1.0).otherwise(0.0)).otherwise(score)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("rm_type"), score.alias("score"))


@query("SELECT l.doc_id, CASE WHEN l.toxic = 1 OR (d.lang = 'en' AND d.n_chars < 500) THEN 0.0 ELSE l.quality::DOUBLE END AS reward FROM labels l JOIN documents d USING (doc_id)")
def r19_audit_gate(spark, sf):
    """A reward is zero if an audit zeroed it, or was applied and not passed."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    zeroed, applied, passed = F.col("toxic") == 1, F.col("lang") == "en", F.col("n_chars") >= 500
    return rows.select("doc_id", F.when(zeroed | (applied & ~passed), 0.0).otherwise(F.col("quality").cast("double")).alias("reward"))


@query("SELECT e.event_id, round(CASE WHEN t.won THEN e.value * 1.2 ELSE e.value * 0.8 END, 6) AS reward FROM events e JOIN (SELECT user_id, max_by(event_type, event_id) IN ('purchase', 'click') AS won FROM events GROUP BY user_id) t USING (user_id)")
def r20_team_reward(spark, sf):
    """All members' rewards rise or fall with whether the team's last step was right."""
    e = table(spark, sf, "events")
    final = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").isin("purchase", "click").alias("won"))
    return e.join(final, "user_id").select("event_id", F.round(F.when(F.col("won"), F.col("value") * 1.2).otherwise(F.col("value") * 0.8), 6).alias("reward"))


@query(
    """WITH m AS (SELECT vec_id, unnest(embedding) > 0 AS m, unnest(range(len(embedding))) AS i FROM embeddings), g AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS run FROM m WHERE m)
    SELECT vec_id, CAST(min(i) AS BIGINT) AS start, count(*) AS n FROM g GROUP BY vec_id, run"""
)
def r23_mask_runs(spark, sf):
    """The runs of places that a mask selects."""
    mask = F.transform("embedding", lambda x: x > 0)
    e = table(spark, sf, "embeddings").select("vec_id", mask.alias("m"))
    starts = F.filter(F.sequence(F.lit(0), F.size("m") - 1), lambda i: F.get("m", i) & ~F.coalesce(F.get("m", i - 1), F.lit(False)))
    ends = F.filter(F.sequence(F.lit(0), F.size("m") - 1), lambda i: F.get("m", i) & ~F.coalesce(F.get("m", i + 1), F.lit(False)))
    return e.select("vec_id", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("r")).select("vec_id", F.col("r.a").cast("long").alias("start"), (F.col("r.b") - F.col("r.a") + 1).cast("long").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k FROM events")
def s12_safe_json(spark, sf):
    """A JSON text that is missing or bad gives null, no error."""
    text = F.when(F.col("event_id") % 8 == 0, F.lit(None)).when(F.col("event_id") % 4 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.from_json(text, "k bigint").getField("k").alias("k"))


@query("SELECT e.event_id FROM events e WHERE e.user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) OR strip_accents(lower(e.event_type)) = 'purchase'")
def j9_semi_or_fuzzy(spark, sf):
    """Rows whose reference is an expected one, or else whose text is."""
    e = table(spark, sf, "events")
    expected = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    by_id = e.join(expected, "user_id", "left_semi").select("event_id")
    by_text = e.join(expected, "user_id", "left_anti").where(F.lower("event_type") == "purchase").select("event_id")
    return by_id.unionByName(by_text)
