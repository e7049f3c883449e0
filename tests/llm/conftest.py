import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=120, seed=1):
    """Small documents with copies, near copies, shared passages, junk, nulls, empty and long texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeou") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda k: [r.choice(words) for _ in range(k)]
    passage, rows = say(50), []
    for k in range(n):
        body = say(r.randint(1, 160))
        if k % 9 == 1 and rows:
            body = (rows[k // 2][1] or "x").split()
        elif k % 9 == 2 and rows:
            body = (rows[k // 2][1] or "x y").split()
            body[r.randrange(len(body))] = "changed"
        elif k % 9 == 3:
            body = say(20) + passage + say(r.randint(0, 20))
        elif k % 9 == 4:
            body = ["lorem", "ipsum", "dolor"] * r.randint(1, 60)
        text = r.choice([" ", "\n", "  ", "\t"]).join(body)
        rows.append((k, text, ["en", "de", None][k % 3], ["a", "b", "c", None][k % 4], len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \n ", "en", "zz", 3), (n + 3, " ".join(say(6000)), "en", "a", 1), (n + 4, "Ünï ▁ 日本 \x00 😀", "de", "b", 9), (None, "no id " * 30, "en", "a", 1)]
    rows += [rows[5], rows[5]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
