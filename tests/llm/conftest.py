import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket long, n_words string, digest string, taken double"


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(1, 8))) for _ in range(n))


def rows():
    """Nulls in every column, empty and long texts, copies, shared passages and lines, ties, odd characters; extra columns of clashing names."""
    shared, line = passage(1, 60), "A line that many documents hold, " + passage(2, 6)
    texts = [passage(100 + i, 30 + i) for i in range(12)]
    texts += [shared, f"{passage(3, 10)} {shared} {passage(4, 10)}", f"{shared}\n{shared}", shared + " x"]
    texts += [f"{passage(50 + i, 5)}\n {line.upper() if i % 2 else line}\t\n{passage(60 + i, 5)}" for i in range(7)]
    texts += ["", "", None, None, " \n\t ", "\n\n", "?!.", "日本語のテキスト 😀 mail a.b@c.de", "x", "A\x0bB\x0cC\x85D E  F"]
    texts += [passage(7, 40_000), "ab" * 5000, ("word " * 3000).strip()]
    texts += ["call +1 (555) 123-4567 or a@b.c, card 4111 1111 1111 1111 not 4111 1111 1111 1112, ip 10.0.0.1 and 300.1.1.1, IBAN DE89 3704 0044 0532 0130 00 bank"]
    texts += [texts[5], texts[5], texts[20]]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, ("en", "fr", "de", None)[i % 4], ("s1", "s1", "s2", "s3", None)[i % 5], None if t is None else len(t), "k", 1, None, "d", 0.5))
    out.append((None, shared, "en", "s1", 5, None, None, "x", None, None))
    out.append((None, None, None, None, None, None, None, None, None, None))
    out.append(out[3])
    out.append((4, "another text of a doc_id that repeats", None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def table():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
