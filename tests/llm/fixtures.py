"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

KIND = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, fp string, words string, shard int, key string, class string, size int, ids string, n long, whole string"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["ba", "ko", "ti", "ru", "é", "sa", "men"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") + ("\n" if i % 23 == 22 else "") for i, w in enumerate(words))


def odd_rows() -> list[tuple]:
    a, b = prose(1, 120), prose(2, 300)
    texts = [
        (1, a), (2, a), (2, a), (3, a + " extra"), (4, b), (4, b + " other end"), (5, ""), (6, None), (7, " \n\t "), (None, prose(3, 80)), (None, None), (8, "one"), (9, "one two"),
        (10, prose(4, 6000)), (11, "x" * 50000), (12, "word " * 4000), (13, "A B C d e f A B C d e f\n" * 5), (14, "Ünïcode  spaces  here 日本 🙂\r\n end "), (15, b.upper()), (16, "\n".join([prose(5, 12)] * 4)),
    ]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        lang = None if i == 3 else "en" if i % 2 else "de"
        source = None if i == 4 else "s1"
        out.append((doc_id, text, lang, source, None if text is None else len(text), i, "x", "y", "z", 1, "k", "c", 2, "q", 3, "w"))
    return out


def odd(spark):
    return spark.createDataFrame(odd_rows(), KIND).repartition(3)


def none(spark):
    return spark.createDataFrame([], KIND)
