import random

import pytest

#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, digest string, n int, fp long, carried string, shard int, blob string, part int, _key long, listed boolean"


def made_texts() -> list[str | None]:
    """Null, empty, blank, short, repeated, near-equal, long and odd texts."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]

    def prose(n: int) -> str:
        return " ".join(r.choice(words) for _ in range(n))

    base = [prose(60) for _ in range(6)]
    passage = prose(80)
    out = [None, "", " \t\n", "one", "two words", "Two  Words", *base, base[0], base[0].replace(" ", "\n", 3), base[1] + " extra", base[2].upper()]
    out += [prose(30) + " " + passage + " " + prose(20), prose(10) + " " + passage, passage + passage, "x" * 5000, prose(4000)]
    out += ["line a b c d e f g h i j\n" * 3, "# * $ % & | < >\n\n# *", "naïve Ünïcode 漢字 ß €\u00a0x\u2003y words for a longer text here now", "don't <|endoftext|> stop 12345 it's ok"]
    out += ['password = "hunter22" token: abc API_KEY:"zzzzzzz" x', "AKIA" + "A1" * 9 + " and " + "0a" * 13, "secret=12345 secret=123456"]
    return [*out, None, "", base[3]]


@pytest.fixture(scope="session")
def rows():
    texts = made_texts()
    rows = [(i * 3 % 41 + 1, t, ["en", "fr", None][i % 3], ["src1", "src0", None, "src2", "src1"][i % 5], 1, 7, "d", 1, 5, "c", 3, "b", 2, 9, True) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, "a row without an id and with some words in it", "en", "src1", *rows[0][4:])]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
