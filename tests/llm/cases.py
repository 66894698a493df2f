"""Tables with what real ones have: nulls, empty and very long texts, ties, repeated rows and clashing names."""

import random

WORDS = "river stone light morning window paper garden silver market winter shadow letter bridge forest music dinner valley copper".split()
DDL = "doc_id long, text string, lang string, source string, n_chars long, rk long, __rk string, id int, score double, `group` int, shard int, h string, quality int"


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def awkward_rows() -> list[tuple]:
    texts = [None, "", " \n ", "x", "word " * 60_000, "ø" * 3000, prose(80, 1), prose(80, 1), prose(80, 2), "a\x00b é 漢字 🙂"]
    rows = [(i, t, "en", "a", len(t or ""), 1, "k", 1, 0.5, 1, 1, "h", 1) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6]]  # the same row again
    rows += [(None, prose(80, 1), None, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 11)]
    rows += [(7, prose(50, 3), "en", "", 5, *[None] * 8)]  # an id that occurs with another text
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DDL)


def empty(spark):
    return spark.createDataFrame([], DDL)
