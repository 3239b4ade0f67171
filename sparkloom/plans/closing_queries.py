"""Further operators by id: projections and parsing (F), ranking (K), steps (M), repeats (N), scores (R), look-ups and builds (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import relational as R
from sparkloom.plans.registry import query, table
from sparkloom.sources import files
from sparkloom.plans.relational_queries import _DOT, _queries


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN '/data/test/' || url ELSE '/data/train/p' || page_id END AS path FROM pages")
def f13_path_key(spark, sf):
    """The row's own path, else one built from its label, else one from its metadata; blank parts do not count."""
    kind = F.col("page_id") % 3
    rows = table(spark, sf, "pages").select(
        "page_id", F.when(kind == 0, F.col("url")).otherwise("").alias("own"), F.when(kind == 1, F.struct(F.lit("test").alias("split"), F.col("url").alias("dir"))).alias("label"),
        F.struct(F.lit(None).cast("string").alias("split"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("dir")).alias("metadata"),
    )
    built = [F.when(F.col(c)["dir"] != "", F.concat(F.lit("/data/"), F.coalesce(F.col(c)["split"], F.lit("train")), F.lit("/"), F.col(c)["dir"])) for c in ("label", "metadata")]
    return rows.select("page_id", F.coalesce(F.nullif("own", F.lit("")), *built).alias("path"))


@query("SELECT conv_id, min_by(role, turn) AS role, md5(min_by(text, turn)) AS text, count(*) FILTER (role = 'assistant') AS n_steps FROM conversations GROUP BY conv_id")
def f28_first_annotation(spark, sf):
    """The first struct of a list, and the steps that are set."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    first = F.try_element_at("t", F.lit(1))
    steps = F.filter(F.transform("t", lambda t: F.when(t["role"] == "assistant", t["text"])), lambda x: x.isNotNull())
    return turns.select("conv_id", first["role"].alias("role"), F.md5(first["text"]).alias("text"), F.size(steps).cast("long").alias("n_steps"))


@query(
    """WITH d AS (SELECT doc_id, text, replace(text, chr(10), ' ') AS flat, length(text) AS n FROM documents WHERE text <> ''),
    s AS (SELECT *, unnest([substr(flat, n // 2 + 1, 20), substr(flat, n // 3 + 1, 20)]) AS s, unnest([1, 2]) AS k FROM d), p AS (SELECT *, strpos(flat, s) AS place FROM s),
    l AS (SELECT doc_id, k, trim(reverse(split_part(reverse(left(text, place - 1)), chr(10), 1)) || substr(text, place, length(s)) || split_part(substr(text, place + length(s)), chr(10), 1), ' ') AS line FROM p),
    u AS (SELECT doc_id, line, min(k) AS k FROM l GROUP BY doc_id, line) SELECT doc_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY k)) AS lines FROM u GROUP BY doc_id"""
)
def f33_enclosing_lines(spark, sf):
    d = table(spark, sf, "documents").where("text <> ''").select("doc_id", "text", F.replace("text", F.lit("\n"), F.lit(" ")).alias("flat"), F.length("text").alias("n"))
    snippets = F.array(*[F.substring("flat", F.floor(F.col("n") / k).cast("int") + 1, F.lit(20)) for k in (2, 3)])
    lines = d.select("doc_id", X.enclosing_lines(F.col("text"), snippets).alias("lines"))
    return lines.select("doc_id", F.size("lines").cast("long").alias("n"), F.md5(F.array_join("lines", "\n")).alias("lines"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'value="' || p_type || '" | title="' || p_brand || '" | ' || CASE WHEN p_size > 25 THEN 'type="search"' ELSE '[checked]' END
    ELSE 'value="' || p_type || '" | ' || CASE WHEN p_size > 25 THEN 'type="search" | [checked]' ELSE '[checked]' END END AS bits FROM part"""
)
def f50_detail_bits(spark, sf):
    attributes = F.create_map(
        F.lit("placeholder"), F.upper("p_name"), F.lit("value"), F.concat(F.lit("  "), F.col("p_type")), F.lit("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" "),
        F.lit("type"), F.when(F.col("p_size") > 25, "search").otherwise("Submit"), F.lit("input_checked"), F.lit("True"),
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.detail_bits(attributes, F.col("p_name")), " | ").alias("bits"))


@query(
    """WITH t AS (SELECT conv_id, turn, length(chr(10) || chr(10) || '[Step ' || turn || ']' || chr(10) || text) AS n FROM conversations)
    SELECT conv_id, turn AS step, 5 + coalesce(sum(n) OVER w, 0)::BIGINT AS start, (5 + coalesce(sum(n) OVER w, 0) + n)::BIGINT AS "end" FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def f56_step_blocks(spark, sf):
    """A conversation written as one trajectory, and the spans of its steps."""
    block = F.concat(F.lit("\n\n[Step "), F.col("turn").cast("string"), F.lit("]\n"), F.col("text"))
    written = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))).alias("t"))
    text = F.concat(F.lit("begin"), F.array_join("t.b", ""))
    spans = written.select("conv_id", F.explode(X.step_blocks(text)).alias("s"))
    return spans.select("conv_id", F.col("s.step").cast("long").alias("step"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query(
    """SELECT conv_id, turn, CASE WHEN k = 0 THEN 'answer' WHEN k < 4 THEN 'code' END AS kind, CASE WHEN k = 0 THEN md5(role || '{' || turn || '}') WHEN k = 1 THEN md5(text) WHEN k IN (2, 3) THEN md5(trim(regexp_replace(text, '[<`]', '', 'g'))) ELSE md5('') END AS content
    FROM (SELECT *, (conv_id + turn) % 5 AS k FROM conversations)"""
)
def f71_tool_action(spark, sf):
    """Replies of each form, with forms of less weight in them too."""
    k = (F.col("conv_id") + F.col("turn")) % 5
    code = F.trim(F.regexp_replace("text", "[<`]", ""))
    tagged, fenced = F.concat(F.lit("x <code>"), code, F.lit("</code>")), F.concat(F.lit("```python\n"), code, F.lit("\n```"))
    call = F.concat(F.lit("<tool_call>"), F.to_json(F.struct(F.lit("code_interpreter").alias("name"), F.struct(F.col("text").alias("code")).alias("arguments"))), F.lit("</tool_call>"))
    boxed = F.concat(F.lit("Answer: \\boxed{"), F.col("role"), F.lit("{"), F.col("turn").cast("string"), F.lit("}}"))
    reply = F.when(k == 0, F.concat(tagged, boxed)).when(k == 1, F.concat(call, tagged)).when(k == 2, F.concat(fenced, tagged)).when(k == 3, fenced).otherwise("nothing")
    a = X.tool_action(reply)
    return table(spark, sf, "conversations").select("conv_id", "turn", a["kind"].alias("kind"), F.md5(a["content"]).alias("content"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN event_type END AS name, CASE WHEN event_id % 4 <> 3 THEN (props->>'$.k')::BIGINT END AS k FROM events")
def f73_last_tool_call(spark, sf):
    """Calls with arguments as an object, as a text, below the function, and with a text that is no JSON."""
    k = F.col("event_id") % 4
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))
    arguments = F.when(k == 1, quoted).when(k == 3, F.lit('"{broken"')).otherwise(F.col("props"))
    inner = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "arguments": '), arguments, F.lit("}"))
    call = F.when(k == 2, F.concat(F.lit('{"function": '), inner, F.lit("}"))).otherwise(inner)
    text = F.concat(F.lit('<tool_call>{"name": "first"}</tool_call> then <tool_call> '), call, F.lit(" </tool_call> end"))
    found = X.last_tool_call(text)
    return table(spark, sf, "events").select("event_id", found["name"].alias("name"), F.get_json_object(found["arguments"], "$.k").cast("long").alias("k"))


@query("""SELECT p_partkey, '{"type":"function","function":{"name":"' || replace(p_name, ' ', '_') || '","description":"' || p_type || '","parameters":{"type":"object","required":["' || p_brand || '"]}}}' AS tool FROM part""")
def f75_tool_schema(spark, sf):
    """A tool's own description in the common shape of functions."""
    parameters = F.struct(F.lit("object").alias("type"), F.array("p_brand").alias("required"))
    function = F.struct(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.col("p_type").alias("description"), parameters.alias("parameters"))
    return table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.lit("function").alias("type"), function.alias("function"))).alias("tool"))


@query(f"SELECT query_id, row_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, row_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS row_id, round({_DOT}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id + 1)) WHERE rank = 1")
def k4_farthest_but_excluded(spark, sf):
    """The least similar row that is not excluded: one more row is fetched for each that may be."""
    found = R.top_k(*_queries(spark, sf), 2, "vec_id", "vec_id", "embedding", descending=False).where("row_id <> query_id + 1")
    least = found.groupBy("query_id").agg(F.min_by(F.struct("row_id", "score"), "rank").alias("r"))
    return least.select("query_id", "r.row_id", F.round("r.score", 5).alias("score"))


@query("SELECT event_id, (event_id * 32 * 8) // 128 AS train_step, event_id AS rollout_step FROM events")
def m5_step_numbers(spark, sf):
    """A rollout's number, and the training step that it stands for: samples so far by the size of a batch."""
    return table(spark, sf, "events").select("event_id", F.expr("event_id * 32 * 8 div 128").alias("train_step"), F.col("event_id").alias("rollout_step"))


@query(
    "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents WHERE text IS NOT NULL), "
    + ", ".join(
        f"r{n} AS (SELECT doc_id, max(c) AS run FROM (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lead(w, {n}) OVER (PARTITION BY doc_id ORDER BY i) = w AS same FROM w) WHERE same) GROUP BY doc_id, g) GROUP BY doc_id)"
        for n in (2, 3, 4)
    )
    + " SELECT d.doc_id, coalesce(r2.run, 0) AS run2, coalesce(r3.run, 0) AS run3, coalesce(r4.run, 0) AS run4 FROM documents d LEFT JOIN r2 USING (doc_id) LEFT JOIN r3 USING (doc_id) LEFT JOIN r4 USING (doc_id) WHERE d.text IS NOT NULL"
)
def n15_equal_runs(spark, sf):
    """The runs from which repeats of chunks of two to four words are told."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", " ").alias("w"))
    return d.select("doc_id", *[X.equal_run(F.col("w"), n).alias(f"run{n}") for n in (2, 3, 4)])


@query(
    """SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.1 ELSE CASE WHEN contains(lower(text), role) THEN 0.3 ELSE 0.2 END END AS score FROM conversations"""
)
def r7_composite_score(spark, sf):
    """Right and wrong answers, in replies with tags in order and out of order, over whole texts as information."""
    k = (F.col("conv_id") + F.col("turn")) % 4
    given = F.when(k.isin(0, 2), F.concat(F.lit("The "), F.upper("role"), F.lit("!"))).otherwise("nobody")
    reply = [F.lit("Say <answer>x</answer>.<|im_start|>assistant\n<think>a</think> <search>b</search>\n<information>"), F.col("text"), F.lit("</information><think>c</think>"), F.when(k.isin(2, 3), "stray").otherwise(" ")]
    text = F.concat(*reply, F.lit("<answer>"), given, F.lit("</answer>\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(X.composite_score(text, F.array("role")), 6).alias("score"))


@query("SELECT conv_id, n_messages, n_chars, prompt FROM (SELECT conv_id, count(*) AS n_messages, sum(length('<|' || role || '|>' || text) + 1)::BIGINT AS n_chars, md5(string_agg('<|' || role || '|>' || text || chr(10), '' ORDER BY turn)) AS prompt FROM conversations GROUP BY conv_id) WHERE n_chars <= 6000")
def s4_dataset_build(spark, sf):
    """Rows to messages, messages to a prompt by the template, and prompts that are too long left out."""
    message = F.struct("turn", F.concat(F.lit("<|"), F.col("role"), F.lit("|>"), F.col("text"), F.lit("\n")).alias("m"))
    built = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("t"))
    prompts = built.select("conv_id", F.size("t").cast("long").alias("n_messages"), F.array_join("t.m", "").alias("prompt"))
    return prompts.where(F.length("prompt") <= 6000).select("conv_id", "n_messages", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("prompt"))


_PARTS = "SELECT part, doc_id, text, row_number() OVER (PARTITION BY part ORDER BY doc_id) - 1 AS i FROM (SELECT lang || '-' || source AS part, * FROM documents)"


@query(f"WITH p AS ({_PARTS}), a AS (SELECT item_id, part, item_id % 40 AS i FROM benchmark, (SELECT DISTINCT part FROM p WHERE part LIKE '%1')) SELECT item_id, a.part, doc_id, md5(text) AS text FROM a JOIN p ON p.part = a.part AND p.i = a.i")
def s21_point_lookup(spark, sf):
    """Also s20: rows by file and place. An index of several files, a file for each language and source, is written and read by both."""
    d = table(spark, sf, "documents").select(F.concat_ws("-", "lang", "source").alias("part"), "doc_id", "text")
    index = files.write_index(d, ["part"], ["doc_id"])
    parts = d.select("part").distinct().where("part LIKE '%1'")
    asked = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 40).alias("place")).join(F.broadcast(parts), how="cross")
    return files.look_up(index, asked, ["part"], "place").select("item_id", "part", "doc_id", F.md5("text").alias("text"))


@query("SELECT user_id, CASE WHEN user_id % 2 = 0 THEN max(event_id) ELSE min(event_id) END AS event_id FROM events GROUP BY user_id")
def s22_resolve_task(spark, sf):
    """A task by its locator if it has one, else the first row of its id in order of path and place."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("_metadata.file_path").alias("path"))
    tasks = e.groupBy("user_id").agg(F.max("event_id").alias("locator")).select("user_id", F.when(F.col("user_id") % 2 == 0, F.col("locator")).alias("locator"))
    located = tasks.join(e.select(F.col("event_id").alias("locator"), F.col("event_id")), "locator").select("user_id", "event_id")
    rest = e.join(tasks.where("locator IS NULL"), "user_id").groupBy("user_id").agg(F.min_by("event_id", F.struct("path", "event_id")).alias("event_id"))
    return located.unionByName(rest)
