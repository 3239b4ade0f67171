import public_tokenizers as P
from tokenizers import Tokenizer

from sparkloom.operators import loss_mask as L

PATH = P.path("byte_bpe_50k.json")


def test_masks_follow_roles_and_steps(spark):
    rows = [
        (1, 0, "system", "Be brief.", None), (1, 1, "user", "Ünïcode 日本 🙂?", None), (1, 2, "assistant", "Sí — 日本!", None), (1, 3, "tool", "LICENSE", None), (1, 4, "assistant", " spaced  out\n", 1), (1, 5, "assistant", "left out", 0),
        (2, 0, "user", None, None), (2, 1, "assistant", "", None), (3, 0, None, "x", None),
    ]
    df = spark.createDataFrame(rows, "conv long, turn int, role string, text string, step int").repartition(3)
    talks = L.conversations(df, "conv", "turn", "role", "text", step_mask="step")
    got = {r["conv"]: r for r in L.token_mask(talks, "conv", PATH, with_texts=True).collect()}
    texts = {r["conv"]: r["text"] for r in talks.collect()}
    tokenizer = Tokenizer.from_file(PATH)
    for conv, r in got.items():
        assert r["ids"] == tokenizer.encode(texts[conv]).ids and len(r["mask"]) == len(r["ids"])
    assert got[1]["texts"] == ["Sí — 日本!<|im_end|>\n", " spaced  out\n<|im_end|>\n"]
    assert got[2]["texts"] == ["<|im_end|>\n"] and got[3]["texts"] == [] and sum(got[3]["mask"]) == 0
    # Brute force: a token is trained if the character that it begins with is.
    trained = [False] * len(texts[1])
    at = 0
    for _, _, role, text, step in sorted(r for r in rows if r[0] == 1):
        head, said = L.HEADER.format(role=role), text + L.END
        for k in range(at + len(head), at + len(head) + len(said)):
            trained[k] = role == "assistant" and step != 0
        at += len(head) + len(said)
    assert got[1]["mask"] == [int(trained[a]) for a, _ in tokenizer.encode(texts[1]).offsets]


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv long, turn int, role string, text string")
    assert L.token_mask(L.conversations(df, "conv", "turn", "role", "text"), "conv", PATH).count() == 0
