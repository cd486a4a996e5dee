import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture_rows():
    random.seed(11)
    voc = [f"w{i}" for i in range(300)] + ["The", "of", "und", "é", "naïve"]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c d"), (7, "x" * 3000), (8, "a " * 2000), (9, "\U0001f642 é a@b.co 10.0.0.1 4111 1111 1111 1111 +1 (524) 555-7373")]
    i = 20
    for _ in range(25):
        base = [random.choice(voc) for _ in range(random.choice([8, 60, 200]))]
        for _ in range(random.randint(1, 5)):
            t = list(base)
            for _ in range(random.choice([0, 0, 1, 2])):
                t[random.randrange(len(t))] = random.choice(voc)
            rows.append((i, " ".join(t)))
            i += 1
    return rows


@pytest.fixture(scope="session")
def rows():
    return fixture_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with nulls, copies, odd texts, a hot source, and columns whose names operators use themselves."""
    data = [(d, t, None if d % 7 == 0 else "en", None if d == 5 else "src%d" % (0 if d % 3 else d % 5), len(t or "")) for d, t in rows]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    return df.selectExpr("*", "1 as n_words", "'q' as shard", "2L as score", "array(1) as spans", "'z' as label", "1 as id", "1.0 as rank", "'h' as host")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
