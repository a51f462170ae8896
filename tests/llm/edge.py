"""Documents with nulls, empty and very long texts, ties, repeated rows and extra columns that clash with results."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, kept string, id int, mark int, code string, contaminated string"


def word(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))


def text(r: random.Random, n: int) -> str:
    return " ".join(word(r) for _ in range(n))


def rows() -> list[tuple]:
    r = random.Random(3)
    base = text(r, 120)
    words = base.split()
    near = words.copy()
    near[60] = "changed"
    out = [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \t\n"),
        (7, "one two"),
        (8, "ONE two"),
        (9, text(r, 20_000)),
        (9, text(random.Random(3), 120)),
        (10, "12 34 --- !!!"),
        (None, base),
        (11, text(r, 60) + " " + " ".join(words[:40])),
        (11, "twice the same row here and there"),
        (11, "twice the same row here and there"),
        (12, "é" * 200),
        (13, "é" * 150),
        (14, "x" * 49),
        (15, text(r, 80)),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if t is None else len(t), "a", "b", "c", 1, 2, "d", "e") for k, (i, t) in enumerate(out)]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
