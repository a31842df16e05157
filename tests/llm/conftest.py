import random
import string

import pytest

SF = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

#: nulls, empty and blank texts, ties, repeated rows, controls, wide characters
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one"), (5, "one"), (None, "null id text here"),
    (None, None), (6, "Ünïcödé wörds ärë hérè 日本語 😀 " * 5), (7, "a b\u0085c   d"), (8, "x" * 5000),
    (9, "the same line\nthe same line\n\n  \nthe same line"), (10, "A b C d E f G h " * 40), (10, "other text same id"),
    (11, "#*$%&|<> !!"), (12, " ".join(str(i) for i in range(30_000))), (13, "▁ literal ▁▁mark"),
    (14, "İstanbul ſecret=abcdefgh KEY api_Key=abcdefghij"), (15, "\x00nul\x00 byte"), (16, "é combining"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with other columns whose names clash with the operators' own."""
    rows = [(d, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "x", 1, None) for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "fp string, cutoffs int, hit_spans string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id = -1")


def noise(rnd: random.Random, n: int, k: int = 400) -> list[str]:
    return ["".join(rnd.choices(string.ascii_lowercase, k=1 + i % 5)) + str(i) for i in rnd.choices(range(k), k=n)]
