"""Text, tag and answer functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.binding import let


def squeeze_ends(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column, lower: bool = False) -> Column:
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.lower(out) if lower else out


def normalise_answer(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(text), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    return squeeze(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalise_answer(text), " "), lambda w: w != "")


def token_f1(prediction: Column, truth: Column) -> Column:
    """f1, precision and recall over tokens; yes, no and noanswer count only if equal."""
    from sparkloom.operators.relational import multiset_overlap

    words, zero = ["yes", "no", "noanswer"], F.lit(0.0)

    def scores(x: Column) -> Column:
        tokens = [F.filter(F.split(x[k], " "), lambda w: w != "") for k in "pt"]
        return let(F.struct(tokens[0].alias("p"), tokens[1].alias("t")), lambda v: from_tokens(x, v))

    def from_tokens(x: Column, v: Column) -> Column:
        return let(multiset_overlap(v["p"], v["t"]).cast("double"), lambda same: finish(x, v, same))

    def finish(x: Column, v: Column, same: Column) -> Column:
        none = (same == 0) | (x["p"] != x["t"]) & (x["p"].isin(words) | x["t"].isin(words))
        precision, recall = (F.when(none, zero).otherwise(F.try_divide(same, F.size(v[k]))) for k in "pt")
        return F.struct(F.when(none, zero).otherwise(2 * precision * recall / (precision + recall)).alias("f1"), precision.alias("precision"), recall.alias("recall"))

    return let(F.struct(normalise_answer(prediction).alias("p"), normalise_answer(truth).alias("t")), scores)


def exact_match(prediction: Column, golds: Column) -> Column:
    return let(normalise_answer(prediction), lambda p: F.exists(golds, lambda g: normalise_answer(g) == p))


def last_tag(text: Column, tag: str, least: int = 1) -> Column:
    """Content of the last <tag>...</tag>, null if there are fewer than ``least``."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.when(F.size(found) >= least, F.trim(F.element_at(found, -1)))


def action_of(text: Column, tail: int = 30) -> Column:
    """action and valid: the action tag's content; valid needs one, reasoning tags and no CJK. Otherwise the text's last characters."""
    action = F.trim(F.lower(F.regexp_extract(text, r"(?is)<action>(.*?)</action>", 1)))
    tagged = text.rlike(r"(?is)<action>.*?</action>")
    reasoned = text.rlike(r"(?is)<think>.*?</think>")
    valid = tagged & (action != "") & reasoned & ~text.rlike(r"[\x{4e00}-\x{9fff}]")
    return F.struct(F.when(tagged, action).otherwise(F.right(text, F.lit(tail))).alias("action"), valid.alias("valid"))


#: Fixed value: what an action may do; hovering and entering count as clicks.
_OPS = "CLICK|TYPE|SELECT|HOVER|ENTER"


def normal_op(op: Column) -> Column:
    plain = F.upper(squeeze(op))
    return F.when(plain.isin("HOVER", "ENTER"), "CLICK").otherwise(plain)


def parse_action_repr(text: Column) -> Column:
    """role, target, op and value of ``[role] target -> OP: value``. A text of another form is all target."""
    pattern = rf"(?i)^\[([^\]]*)\]\s*(.*?)\s*->\s*({_OPS})(?:\s*:\s*(.*))?$"

    def parts(raw: Column) -> Column:
        held, part = raw.rlike(pattern), lambda i: F.regexp_extract(raw, pattern, i)
        found = lambda c: F.when(held, c).otherwise("")
        target = F.when(held, F.btrim(squeeze(part(2)), F.lit(" ."))).otherwise(raw)
        return F.struct(found(squeeze(part(1), lower=True)).alias("role"), target.alias("target"), found(normal_op(part(3))).alias("op"), found(squeeze(part(4))).alias("value"))

    return let(squeeze(text), parts)


def parse_model_action(text: Column) -> Column:
    """op, ref and value of a JSON object with these keys, or of ``OP eN | value`` (or a colon). A text of another form is all value."""
    pattern = rf"(?is)^({_OPS})\s+(e\d+)(?:\s*(?:\||:)\s*(.*))?$"
    keys = ("op", "ref", "value")

    def parts(raw: Column) -> Column:
        parsed, held = F.try_parse_json(raw), raw.rlike(pattern)
        of_json = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
        fields = [F.when(of_json, squeeze(F.try_variant_get(parsed, f"$.{k}", "string"))).when(held, squeeze(F.regexp_extract(raw, pattern, i))).otherwise(raw if k == "value" else "") for i, k in enumerate(keys, 1)]
        return F.struct(normal_op(fields[0]).alias("op"), fields[1].alias("ref"), fields[2].alias("value"))

    return let(squeeze(text), parts)


def web_action(text: Column, tail: int = 200) -> Column:
    """op, ref, value and valid of the first action tag; valid needs op and ref. Without a tag the text's last characters are read, and nothing is valid."""
    tagged = text.rlike(r"(?is)<action>.*?</action>")
    said = F.when(tagged, F.regexp_extract(text, r"(?is)<action>(.*?)</action>", 1)).otherwise(F.right(text, F.lit(tail)))
    return let(parse_model_action(said), lambda a: F.struct(a["op"].alias("op"), a["ref"].alias("ref"), a["value"].alias("value"), (tagged & (a["op"] != "") & (a["ref"] != "")).alias("valid")))


def unwrapped(values: Column) -> Column:
    """The one value of a list of one, null for others."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def admissible(actions: Column, without: str = "help") -> Column:
    """A list of actions as text, each in quotes on its own line, without the one that does nothing."""
    return F.array_join(F.transform(F.filter(actions, lambda a: a != without), lambda a: F.concat(F.lit("'"), a, F.lit("'"))), ",\n ")


def type_label(domain: Column, subdomain: Column) -> Column:
    d, s = F.nullif(F.trim(domain), F.lit("")), F.nullif(F.trim(subdomain), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws("/", d, s), F.lit("")), F.lit("unknown"))


def grammar_prompt(text: Column) -> Column:
    """What follows 'Your task is to:' up to a quote or line end, without a last full stop."""
    return F.nullif(F.regexp_replace(F.trim(F.regexp_extract(text, r'(?i)Your task is to:\s*([^"\n]+)', 1)), r"[\s.]+$", ""), F.lit(""))


def loose_bool(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y", "on")


def search_query(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, r"(?U)[^\p{L}\p{M}\p{N}_\s]", " "))


def snippet_segments(text: Column) -> Column:
    """Segments between dots of omission with more than five words."""
    return F.filter(F.transform(F.split(text, r"\.\.\."), lambda s: F.trim(s)), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) > 5)


def message_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "\n")


def passages(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), r["title"], F.lit(") "), r["text"], F.lit("\n"))), "")


def tag_action(text: Column) -> Column:
    """tag and content of the first <search> or <answer>."""
    pattern = r"(?s)<(search|answer)>(.*?)</\1>"
    return F.struct(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias("tag"), F.trim(F.regexp_extract(text, pattern, 2)).alias("content"))


def cut_after(text: Column, closing: list[str]) -> Column:
    """The text up to and with the first closing tag."""
    ends = [F.when(F.locate(t, text) > 0, F.locate(t, text) + len(t) - 1) for t in closing]
    end = F.least(*ends) if len(ends) > 1 else ends[0]
    return F.when(end.isNotNull(), F.substring(text, F.lit(1), end)).otherwise(text)


def judgment_index(text: Column, n: Column) -> Column:
    """Zero-based choice of 'Judgment: k', null if out of bounds."""
    k = F.regexp_extract(text, r"(?i)Judgment:\s*(\d+)", 1).try_cast("int")
    return F.when(k.between(1, n), k - 1)


def has_char_run(text: Column, least: int = 8) -> Column:
    """A character repeated without a break; runs of blanks count as one blank."""
    return F.trim(F.regexp_replace(text, r"[ \t]+", " ")).rlike(rf"(.)\1{{{least - 1},}}")


def has_suspicious_characters(text: Column) -> Column:
    return text.rlike(r"[\p{Cf}\p{Cs}\p{Co}\p{Cn}\x{FFFD}]|[\p{Cc}&&[^\t\n\r]]")


def has_non_english_characters(text: Column) -> Column:
    return text.rlike(r"[\x{80}-\x{10FFFF}&&[^\p{S}\p{P}\p{Z}]]")


def has_token_run(text: Column, least: int = 8) -> Column:
    """The same token (case aside) at least ``least`` times in a row."""
    tokens = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(w == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(tokens, start, step, lambda a: a["best"]) >= least


def multiple_choice(text: Column, valid: str = "ABCDEFGH") -> Column:
    """The letter that a reply settles on, behind its thinking: as named by a phrase, else the last valid capital that stands alone."""
    # Phrases around the letter, in order of weight.
    phrases = [r"(?i)(?:answer|option|choice)\s*(?:is|:)?\s*([A-Z])", r"(?i)([A-Z])\s*(?:is\s*(?:the)?\s*correct)", r"(?i)final\s*(?:answer|option)\s*(?:is|:)?\s*([A-Z])"]
    reply = F.substring_index(text, "</think>", -1)
    named = [F.upper(F.regexp_extract(reply, p, 1)) for p in phrases]
    alone = F.regexp_extract_all(reply, F.lit(rf"\b([{valid}])\b"), F.lit(1))
    return F.coalesce(*[F.when(n.isin(*valid), n) for n in named], F.try_element_at(alone, F.lit(-1)))


def has_repeated_line(text: Column, least: int = 3, share: float = 0.5, chars: int = 12) -> Column:
    """Whether one line of ``chars`` characters or more stands often enough, and makes up enough of the lines. Sorted, so that equal lines are neighbours."""

    def judge(lines: Column) -> Column:
        long = F.sort_array(F.filter(lines, lambda x: F.length(x) >= chars))
        return let(long, lambda x: F.when(F.size(x) > 0, equal_run(x, 1) + 1).otherwise(0)).between(F.greatest(F.lit(float(least)), share * F.size(lines)), F.lit(float("inf")))

    return let(F.filter(F.transform(F.split(F.lower(text), r"\R"), squeeze_ends), lambda x: x != ""), judge)


def audit(text: Column) -> Column:
    """Verdict of the rule-based audit: pass, and the reasons joined by ' | '. The first kind of repetition found is the one given."""
    text = F.coalesce(text, F.lit(""))
    tokens = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    repeats = F.when(has_char_run(text), "long character run").when(has_token_run(text), "repeated token").when(has_repeated_chunk(tokens), "repeated chunk").when(has_repeated_line(text), "repeated line")
    reasons = F.concat_ws(" | ", F.when(has_suspicious_characters(text), "suspicious characters"), F.when(has_non_english_characters(text), "non-English characters"), repeats)
    return let(reasons, lambda r: F.struct((r == "").alias("pass"), r.alias("reasons")))


def equal_run(tokens: Column, distance: int, chars: int = 0) -> Column:
    """The longest run of tokens that equal the one ``distance`` places before, one fold over the tokens. A run of (n - 1) * distance is a chunk of that size n times in a row. Chunks of fewer characters than ``chars`` do not count."""

    def step(a, x):
        run = F.when(x, a["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    def longest(words: Column) -> Column:
        later = F.slice(words, F.lit(distance + 1), F.greatest(F.size(words) - distance, F.lit(0)))
        enough = lambda i: F.length(F.array_join(F.slice(words, i + 1, F.lit(distance)), " ")) >= chars
        same = F.transform(later, lambda x, i: (x == F.get(words, i)) & enough(i) if chars else x == F.get(words, i))
        return F.aggregate(same, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda a: a["best"].cast("long"))

    return let(tokens, longest)


def has_repeated_chunk(tokens: Column, least: int = 4, chars: int = 8) -> Column:
    """Whether a chunk of two to four tokens stands ``least`` times in a row or more."""

    def judge(words: Column) -> Column:
        found = [equal_run(words, n, chars) >= (least - 1) * n for n in (2, 3, 4)]
        return found[0] | found[1] | found[2]

    return let(tokens, judge)


def valid_tag_sequence(text: Column) -> Column:
    """Behind the reply's marker: thinking, any number of searches with information and further thinking, an answer; only white space between."""
    reply = F.regexp_extract(text, r"(?s)<\|im_start\|>assistant\s*(.*)", 1)
    tag = r"</?(?:think|search|information|answer)>"
    tags = F.array_join(F.regexp_extract_all(reply, F.lit(tag), F.lit(0)), "")
    order = tags.rlike("^<think></think>(?:<search></search><information></information><think></think>)*<answer></answer>$")
    return order & F.forall(F.transform(F.split(reply, tag), lambda x, i: (i % 2 == 1) | (squeeze(x) == "")), lambda ok: ok)


def composite_score(text: Column, golds: Column, structure: float = 0.2, final: float = 0.1, retrieval: float = 0.1, score: float = 1.0) -> Column:
    """Exact match of the last of two or more answers, less the structure's share if tags are out of order; otherwise the shares for structure and for information that holds a gold answer."""
    valid, answer = valid_tag_sequence(text), last_tag(text, "answer", 2)
    blocks = F.transform(F.regexp_extract_all(text, F.lit("(?s)<information>(.*?)</information>"), F.lit(1)), normalise_answer)
    found = let(F.transform(golds, normalise_answer), lambda wanted: F.exists(blocks, lambda b: F.exists(wanted, lambda g: F.contains(b, g))))
    kept = F.when(found, structure + retrieval).otherwise(structure)
    right = answer.isNotNull() & F.coalesce(exact_match(answer, golds), F.lit(False))
    return F.when(right & valid, score).when(right, score - structure).when(valid, kept).when(answer.isNull(), 0.0).otherwise(final)


def enclosing_lines(doc: Column, snippets: Column) -> Column:
    """The lines around each snippet that the text holds, distinct, in order. A snippet may run over a line's end."""

    def around(s, flat):
        at = F.position(s, flat)
        head = F.substring_index(F.substring(doc, F.lit(1), at - 1), "\n", -1)
        tail = F.substring_index(F.substring(doc, at + F.length(s), F.length(doc)), "\n", 1)
        return F.when(at > 0, F.trim(F.concat(head, F.substring(doc, at, F.length(s)), tail)))

    found = let(F.replace(doc, F.lit("\n"), F.lit(" ")), lambda flat: F.transform(snippets, lambda s: around(s, flat)))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def detail_bits(attributes: Column, primary: Column, most: int = 3) -> Column:
    """Up to ``most`` attributes that say more than the primary name, as key="value" of ten words at most."""
    # The attributes in their order, and types that say nothing.
    keys = ["placeholder", "value", "input_value", "text_value", "title", "aria_label", "type"]
    plain_types = ["text", "button", "submit"]
    marks = {"input_checked": "[checked]", "option_selected": "[selected]"}

    def bit(key):
        value = squeeze(F.try_element_at(attributes, F.lit(key)))
        said = (value == "") | (F.lower(value) == squeeze(primary, lower=True))
        if key == "type":
            said = said | F.lower(value).isin(plain_types)
        return F.when(~said, F.concat(F.lit(f'{key}="'), F.array_join(F.slice(F.split(value, " "), 1, 10), " "), F.lit('"')))

    flags = [F.when(squeeze(F.try_element_at(attributes, F.lit(k)), lower=True) == "true", F.lit(v)) for k, v in marks.items()]
    return F.slice(F.array_compact(F.array(*[bit(k) for k in keys], *flags)), 1, most)


def step_blocks(text: Column) -> Column:
    """step, start and end (from 0) of each block that a step's header opens."""
    header = "\n\n\\[Step (\\d+)\\]\n"
    steps = F.transform(F.regexp_extract_all(text, F.lit(header), F.lit(1)), lambda s: s.cast("int"))
    heads = F.transform(F.regexp_extract_all(text, F.lit(header), F.lit(0)), F.length)
    parts = F.transform(F.split(text, header, -1), F.length)

    def places(x: Column) -> Column:
        # Where each block begins, and the end: lengths added up.
        ends = F.aggregate(x["heads"], F.struct(F.array(F.get(x["parts"], F.lit(0))).alias("at"), F.lit(1).alias("k")), lambda a, n: F.struct(F.concat(a["at"], F.array(F.element_at(a["at"], -1) + n + F.get(x["parts"], a["k"]))).alias("at"), (a["k"] + 1).alias("k")), lambda a: a["at"])
        return let(ends, lambda e: F.transform(x["steps"], lambda s, i: F.struct(s.alias("step"), F.get(e, i).alias("start"), F.get(e, i + 1).alias("end"))))

    return let(F.struct(steps.alias("steps"), heads.alias("heads"), parts.alias("parts")), places)


def tool_action(text: Column) -> Column:
    """kind and content of a reply: a boxed answer, else the code of an interpreter's call, of code tags, or of a fenced block."""
    answer = r"(?s)Answer:\s*\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"
    call = F.regexp_extract(text, r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1)
    parsed = F.from_json(F.replace(call, F.lit("\n"), F.lit("\\n")), "name string, arguments struct<code: string>")
    code = F.when(parsed["name"] == "code_interpreter", parsed["arguments"]["code"])
    tags, fence = r"(?s)<code>(.*?)</code>", r"(?s)```python\s*(.*?)\s*```"
    pair = lambda kind, content: F.struct(F.lit(kind).alias("kind"), content.alias("content"))
    found = F.when(text.rlike(answer), pair("answer", F.trim(F.regexp_extract(text, answer, 1)))).when(F.trim(code) != "", pair("code", code))
    for pattern in (tags, fence):
        found = found.when(text.rlike(pattern), pair("code", F.trim(F.regexp_extract(text, pattern, 1))))
    return found.otherwise(pair(None, F.lit("")))


def last_tool_call(text: Column) -> Column:
    """name and arguments (JSON) of the last call; arguments given as a JSON text are read once more. Null if it has no name or is not valid."""
    raw = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1)), F.lit(-1))
    name = F.coalesce(F.get_json_object(raw, "$.name"), F.get_json_object(raw, "$.function.name"))
    # A string of JSON and the object itself both come out as the object's text.
    arguments = F.coalesce(F.get_json_object(raw, "$.arguments"), F.get_json_object(raw, "$.function.arguments"), F.lit("{}"))
    ok = (name != "") & F.try_parse_json(arguments).isNotNull()
    return F.when(ok, F.struct(name.alias("name"), arguments.alias("arguments")))
