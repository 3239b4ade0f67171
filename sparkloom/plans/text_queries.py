"""Scalar text functions (F), scores (R) and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import pages
from sparkloom.plans.registry import query, table

_SQUEEZE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_NORM = r"array_to_string(list_filter(string_split(trim(regexp_replace(translate(lower(text), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('a', 'an', 'the')), ' ')"


@query(f"SELECT doc_id, md5({_SQUEEZE}) AS squeezed, length({_SQUEEZE}) AS n FROM documents")
def f24_squeeze(spark, sf):
    s = X.squeeze(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(s).alias("squeezed"), F.length(s).cast("long").alias("n"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE lang || '/' || source END AS label FROM documents")
def f25_type_label(spark, sf):
    d = F.when(F.col("lang") != "en", F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", X.type_label(d, F.col("source")).alias("label"))


@query("SELECT page_id, split_part(split_part(regexp_replace(url, '^https?://', ''), '/', 1), ':', 1) AS host, len(string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/')) - 1 AS depth FROM pages")
def f30_path_parts(spark, sf):
    """Also f4: parts of a path."""
    rest = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf, "pages").select("page_id", F.split_part(F.split_part(rest, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1)).alias("host"), (F.size(F.split(F.regexp_replace(rest, "[?#].*$", ""), "/")) - 1).cast("long").alias("depth"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS query FROM benchmark")
def f31_search_query(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.search_query(F.col("text")).alias("query"))


@query("SELECT item_id, len(list_filter(list_transform(string_split(text, '.'), lambda s: trim(s)), lambda s: len(string_split(s, ' ')) > 5)) AS n FROM benchmark")
def f32_segments(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(X.snippet_segments(F.regexp_replace("text", r"\.", "..."))).cast("long").alias("n"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def f36_message_text(spark, sf):
    """Also f68: the texts of a conversation's messages, one below the other."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("m"))
    return c.select("conv_id", F.md5(X.message_text(F.col("m"))).alias("text"))


@query("SELECT conv_id, turn, trim(split_part(lower(text), '</action>', 1)) AS action, turn % 2 = 0 AND trim(split_part(lower(text), '</action>', 1)) <> '' AND NOT regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS valid FROM conversations WHERE role = 'assistant'")
def f42_whole_action(spark, sf):
    """f42 with whole texts, further tags behind them, and reasoning at every other turn."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    think = F.when(F.col("turn") % 2 == 0, F.lit("<think>so\n</think> ")).otherwise("")
    a = X.action_of(F.concat(think, F.lit("x <action>"), F.col("text"), F.lit("</Action> then\n<action>other</action>")))
    return c.select("conv_id", "turn", a["action"].alias("action"), a["valid"].alias("valid"))


@query("SELECT event_id, event_type AS role, 'item ' || user_id AS target, CASE WHEN event_type IN ('view', 'click') THEN 'CLICK' ELSE 'TYPE' END AS op, CAST(event_id AS VARCHAR) AS value FROM events")
def f45_action_repr(spark, sf):
    op = F.when(F.col("event_type") == "view", "hover").when(F.col("event_type") == "click", "CLICK").otherwise("TYPE")
    text = F.concat(F.lit("["), "event_type", F.lit("] item "), F.col("user_id").cast("string"), F.lit(" -> "), op, F.lit(": "), F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", X.parse_action_repr(text).alias("a")).select("event_id", "a.*")


@query("SELECT event_id, 'TYPE' AS op, 'e' || user_id AS ref, event_type AS value FROM events")
def f46_model_action(spark, sf):
    ref = F.concat(F.lit("e"), F.col("user_id").cast("string"))
    plain = F.concat(F.lit("type "), ref, F.lit(" | "), "event_type")
    json = F.to_json(F.struct(F.lit("type").alias("op"), ref.alias("ref"), F.col("event_type").alias("value")))
    text = F.when(F.col("event_id") % 2 == 0, plain).otherwise(json)
    return table(spark, sf, "events").select("event_id", X.parse_model_action(text).alias("a")).select("event_id", "a.*")


@query("SELECT doc_id, regexp_matches(text, '[^\\x00-\\x7F]') AS non_ascii, regexp_matches(regexp_replace(text, '[\\p{S}\\p{P}\\p{Z}\\x00-\\x7F]', '', 'g'), '.') AS non_english FROM documents")
def f60_non_english(spark, sf):
    """Also f59, f62: parts of the audit."""
    return table(spark, sf, "documents").select("doc_id", F.col("text").rlike(r"[^\x00-\x7F]").alias("non_ascii"), X.has_non_english_characters(F.col("text")).alias("non_english"))


_AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, list_filter(string_split_regex(lower(t), '[\s\x0b\x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM d)),
chars AS (SELECT doc_id, unnest(c) AS w, unnest(range(len(c))) AS i FROM (SELECT doc_id, string_split(trim(regexp_replace(t, '[ \t]+', ' ', 'g')), '') AS c FROM d WHERE t <> '')),
char_runs AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, w, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS g FROM chars) WHERE w NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233)) GROUP BY doc_id, w, g HAVING count(*) >= 8),
word_runs AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, w, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS g FROM words) GROUP BY doc_id, w, g HAVING count(*) >= 8),
steps AS (SELECT w.*, n, length(string_agg(w, ' ') OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)) >= 8 AND lead(w, n) OVER (PARTITION BY doc_id, n ORDER BY i) = w AS same FROM words w, (VALUES (2), (3), (4)) x(n)),
chunks AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, n, i - row_number() OVER (PARTITION BY doc_id, n ORDER BY i) AS g FROM steps WHERE same) GROUP BY doc_id, n, g HAVING count(*) >= 3 * n),
lines AS (SELECT doc_id, trim(l, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS l FROM (SELECT doc_id, unnest(string_split_regex(lower(t), '\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]')) AS l FROM d)),
line_counts AS (SELECT doc_id, l, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM lines WHERE l <> '' GROUP BY doc_id, l),
same_lines AS (SELECT DISTINCT doc_id FROM line_counts WHERE length(l) >= 12 AND n >= 3 AND n >= 0.5 * total),
judged AS (SELECT doc_id, concat_ws(' | ',
  CASE WHEN regexp_matches(t, '[\p{Cf}\p{Cs}\p{Co}\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]') THEN 'suspicious characters' END,
  CASE WHEN regexp_matches(regexp_replace(t, '[\p{S}\p{P}\p{Z}\x00-\x7F]', '', 'g'), '.') THEN 'non-English characters' END,
  CASE WHEN doc_id IN (FROM char_runs) THEN 'long character run' WHEN doc_id IN (FROM word_runs) THEN 'repeated token' WHEN doc_id IN (FROM chunks) THEN 'repeated chunk' WHEN doc_id IN (FROM same_lines) THEN 'repeated line' END) AS reasons FROM d)
SELECT doc_id, reasons = '' AS pass, reasons FROM judged"""


@query(_AUDIT)
def f61_audit(spark, sf):
    """Also f59, f62, n14: the audit's verdict of each document."""
    return table(spark, sf, "documents").select("doc_id", X.audit(F.col("text")).alias("a")).select("doc_id", "a.*")


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'widget') THEN 'widget' WHEN contains(p_name, 'red') THEN 'red' ELSE 'other' END AS kind FROM part")
def f65_class_by_substring(spark, sf):
    """Also f63: the first of an ordered list of substrings."""
    out = F.lit("other")
    for k in reversed(("ring", "widget", "red")):
        out = F.when(F.contains("p_name", F.lit(k)), k).otherwise(out)
    return table(spark, sf, "part").select("p_partkey", out.alias("kind"))


@query("SELECT item_id, 'answer' AS tag, text AS content, '<answer>' || text || '</answer>' AS cut FROM benchmark")
def f70_tag_action(spark, sf):
    """Also f69, f72."""
    wrapped = F.concat(F.lit("<answer>"), "text", F.lit("</answer> and more <search>x</search>"))
    b = table(spark, sf, "benchmark").select("item_id", X.tag_action(wrapped).alias("a"), X.cut_after(wrapped, ["</search>", "</answer>"]).alias("cut"))
    return b.select("item_id", "a.tag", "a.content", "cut")


@query("SELECT vec_id, CASE WHEN label BETWEEN 1 AND 5 THEN label - 1 ELSE -1 END AS choice FROM embeddings")
def f76_judgment(spark, sf):
    text = F.concat(F.lit("So.\nJudgment: "), F.col("label").cast("string"))
    return table(spark, sf, "embeddings").select("vec_id", F.coalesce(X.judgment_index(text, F.lit(5)), F.lit(-1)).alias("choice"))


@query(f"SELECT item_id, {_NORM} AS answer FROM benchmark")
def r3_normalised_answer(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.normalise_answer(F.col("text")).alias("answer"))


_TOKENS = f"(SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(string_split({_NORM}, ' ')) AS w FROM benchmark) WHERE w <> '' GROUP BY ALL)"


@query(f"WITH t AS {_TOKENS}, s AS (SELECT item_id, sum(n) AS n FROM t GROUP BY item_id), o AS (SELECT a.item_id, sum(least(a.n, b.n)) AS o FROM t a JOIN t b ON a.w = b.w AND b.item_id = a.item_id + 1 GROUP BY a.item_id) SELECT o.item_id, round(2 * o / (a.n + b.n), 6) AS f1, round(o / a.n, 6) AS precision, round(o / b.n, 6) AS recall FROM o JOIN s a ON a.item_id = o.item_id JOIN s b ON b.item_id = o.item_id + 1")
def r4_token_f1(spark, sf):
    b = table(spark, sf, "benchmark")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("truth")), "item_id")
    out = pairs.select("item_id", X.token_f1(F.col("text"), F.col("truth")).alias("s")).where("s.f1 > 0")
    return out.select("item_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("f1", "precision", "recall")])


@query("SELECT item_id, true AS em, false AS other FROM benchmark")
def r5_exact_match(spark, sf):
    """Also r8: an answer in tags against gold answers, case and articles aside."""
    answer = F.concat(F.lit("<answer>no</answer> <answer>The "), F.lower("text"), F.lit("</answer>"))
    b = table(spark, sf, "benchmark").withColumn("answer", X.last_tag(answer, "answer", least=2))
    return b.select("item_id", X.exact_match(F.col("answer"), F.array(F.lit("x"), F.col("text"))).alias("em"), X.exact_match(F.col("answer"), F.array(F.lit("x"))).alias("other"))


@query("""SELECT conv_id, turn, substr('ABCD', conv_id % 4 + 1, 1) AS letter FROM conversations WHERE NOT regexp_matches(text, '(?i)answer|option|choice|correct')""")
def r15_multiple_choice(spark, sf):
    """Letters named before and behind whole texts, in thinking that does not count, and alone."""
    letter = F.substring(F.lit("ABCD"), (F.col("conv_id") % 4 + 1).cast("int"), F.lit(1))
    k = F.col("turn") % 4
    said = F.when(k == 0, F.concat(F.lit("\nThe answer is "), letter)).when(k == 1, F.concat(F.lit("\n"), F.lower(letter), F.lit(" is correct, not H"))).when(k == 2, F.concat(F.lit("\nPerhaps Z or H, so "), letter)).otherwise(F.concat(F.lit("the answer is H</think> Option: "), letter))
    rows = table(spark, sf, "conversations").where("NOT text RLIKE '(?i)answer|option|choice|correct'")
    return rows.select("conv_id", "turn", X.multiple_choice(F.concat("text", said)).alias("letter"))


@query("SELECT event_id, round(value * CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 2 ELSE 0.5 END, 6) AS reward FROM events")
def r18_weighted_reward(spark, sf):
    weight = F.when(F.col("event_type") == "error", 0.0).when(F.col("event_type") == "purchase", 2.0).otherwise(0.5)
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") * weight, 6).alias("reward"))


@query()
def f47_page_elements(spark, sf):
    """Also f48, f49, f51, n9: the elements of each page in document order, with role, name and ordinal."""
    return pages.snapshot(table(spark, sf, "pages").select("page_id", "html"), "page_id", "html")
