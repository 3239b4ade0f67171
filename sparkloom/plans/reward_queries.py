"""Rewards by kind (R1, R2, R10-R15, R17) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import answers as A
from sparkloom.operators import loss_mask, rewards
from sparkloom.plans.registry import query, table


@query(
    """WITH e AS (SELECT event_id, user_id AS u, (props->>'$.k')::BIGINT AS k, value, event_type FROM events)
    SELECT event_id, CASE event_id % 5
      WHEN 0 THEN (event_id % 3 <> 0 AND value <> floor(value))::INT
      WHEN 1 THEN CASE WHEN u = k THEN 1.0 ELSE -1.0 END
      WHEN 2 THEN CASE WHEN event_type IN ('purchase', 'error') THEN round(2 / 3.0, 6) ELSE 0 END
      WHEN 3 THEN (u % 8 = k % 8)::INT
      ELSE (u = k)::INT END::DOUBLE AS reward FROM e"""
)
def r1_rewards(spark, sf):
    """Also r2, r24: replies of five kinds, one of them by default. Decimals against fractions, whole numbers, tokens, letters behind thinking, tuples."""
    k, u = F.get_json_object("props", "$.k").cast("long"), F.col("user_id")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    letter = lambda n: F.get(F.array(*map(F.lit, rewards.LETTERS)), (n % 8).cast("int"))
    hundredths = F.round(F.col("value") * 100).cast("long") + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    kinds = [
        ("math", text("So \\boxed{1} or \\boxed{", F.col("value").cast("decimal(20,2)").cast("string"), "}"), text(hundredths.cast("string"), "/100")),
        (None, text("Answer: 0\nAnswer: x = $", k.cast("string"), "$"), u.cast("string")),
        ("f1", F.upper("event_type"), F.lit("The purchase, an error!")),
        ("gpqa", text("<think>The answer is H</think>\nIt may be Z. ", letter(k), " is correct"), letter(u)),
        ("deepscaler", text("<think>\\boxed{0}</think> \\boxed{(", u.cast("string"), ", ", k.cast("string"), ")}"), text("\\boxed{(", k.cast("string"), ",", u.cast("string"), ")}")),
    ]
    pick = lambda at: F.get(F.array(*[F.lit(x[at]).cast("string") if not hasattr(x[at], "cast") else x[at] for x in kinds]), (F.col("event_id") % 5).cast("int"))
    replies = table(spark, sf, "events").select("event_id", pick(0).alias("rm_type"), pick(1).alias("response"), pick(2).alias("label"))
    return rewards.rewards(replies, default="dapo").select("event_id", F.round("reward", 6).alias("reward"))


@query("SELECT o_orderkey, k * k * m = n AS same FROM (SELECT o_orderkey, o_custkey % 72 + 1 AS n, o_orderkey % 3 + 1 AS k, o_orderkey % 9 + 1 AS m FROM orders)")
def r10_same_roots(spark, sf):
    """Also r11, r12: a root against a number times a root, in LaTeX."""
    n, k, m = (x.cast("string") for x in (F.col("o_custkey") % 72 + 1, F.col("o_orderkey") % 3 + 1, F.col("o_orderkey") % 9 + 1))
    given = F.concat(k, F.lit("\\sqrt{"), m, F.lit("}"))
    return table(spark, sf, "orders").select("o_orderkey", A.same_answer(given, F.concat(F.lit("\\sqrt{"), n, F.lit("}"))).alias("same"))


@query("SELECT conv_id, turn, CASE WHEN contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), w) THEN 1.0 ELSE 0.0 END AS reward FROM (SELECT conv_id, turn, text, trim(regexp_replace(lower(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), 'no more')), '[^a-z0-9]+', ' ', 'g')) AS all_words, split_part(all_words, ' ', 1) || ' ' || split_part(all_words, ' ', 2) AS w FROM conversations) WHERE NOT regexp_matches(text, '(^|[^\\p{L}\\p{M}\\p{N}_])[A-H]([^\\p{L}\\p{M}\\p{N}_]|$)') AND NOT list_has_any(list_transform(['(?i)(?:answer|option|choice)\\s*(?:is|:)?\\s*([A-Z])', '(?i)([A-Z])\\s*(?:is\\s*(?:the)?\\s*correct)', '(?i)final\\s*(?:answer|option)\\s*(?:is|:)?\\s*([A-Z])'], lambda p: upper(regexp_extract(text, p, 1))), ['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H'])")
def r15_choice_texts(spark, sf):
    """Replies that name no letter: the reward is whether they hold the words with which the next turn begins."""
    from pyspark.sql import Window

    later = F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("no more"))
    words = F.split(F.btrim(F.regexp_replace(F.lower(later), "[^a-z0-9]+", " "), F.lit(" ")), " ")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.concat_ws(" ", F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit(""))).alias("label"))
    letters = F.array(*map(F.lit, rewards.LETTERS))
    return rows.where(rewards.chosen_letter(F.col("text"), letters).isNull()).select("conv_id", "turn", rewards.choice_reward(F.col("text"), F.col("label")).alias("reward"))


@query(
    """WITH m AS (SELECT conv_id, turn, role, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS said, role = 'assistant' AND turn % 4 <> 3 AS told FROM conversations),
    s AS (SELECT *, told AND NOT coalesce(lag(told) OVER (PARTITION BY conv_id ORDER BY turn), false) AS first FROM m)
    SELECT conv_id, sum(length(head) + length(said))::BIGINT AS n_chars, coalesce(sum(length(said)) FILTER (told), 0)::BIGINT AS n_trained, count(*) FILTER (told) AS n_runs, md5(coalesce(string_agg(said, '|' ORDER BY turn) FILTER (told), '')) AS texts FROM s GROUP BY conv_id"""
)
def r21_token_mask(spark, sf):
    """Also r22, r23: the mask over the ids of a byte-level vocabulary; every fourth turn is left out by its own mask. What the runs of 1 decode to is what the trained messages say."""
    import public_tokenizers

    c = table(spark, sf, "conversations").withColumn("step_mask", F.when(F.col("turn") % 4 == 3, 0))
    talks = loss_mask.conversations(c, "conv_id", "turn", "role", "text", step_mask="step_mask")
    masks = loss_mask.token_mask(talks, "conv_id", public_tokenizers.path("byte_bpe_50k.json"), with_texts=True)
    told = F.transform("texts", lambda x: F.length(x))
    out = masks.join(talks.select("conv_id", F.length("text").cast("long").alias("n_chars")), "conv_id")
    return out.select("conv_id", "n_chars", F.aggregate(told, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_trained"), F.size("texts").cast("long").alias("n_runs"), F.md5(F.array_join("texts", "|")).alias("texts"))
