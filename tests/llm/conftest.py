import random

import pytest

WORDS = "the of and to in is that for it as with was on be by this are or an at from idiot".split()


def text_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") * rng.randrange(2) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with NULLs, empty and very long texts, copies, repeated rows and shared passages."""
    rng = random.Random(7)
    shared = text_of(rng, 70)
    rows = [(i, text_of(rng, rng.randrange(1, 120)), "en", rng.choice("abc"), 1) for i in range(60)]
    rows += [(100 + i, f"{text_of(rng, 5)} {shared} {text_of(rng, i)}", "en", "a", 1) for i in range(6)]
    rows += [(200 + i, shared, "en", "hot", 1) for i in range(40)]
    rows += [(300, None, None, None, None), (301, "", "en", "b", 0), (302, " \t\n ", "en", "b", 3)]
    rows += [(303, text_of(rng, 30_000), "en", "c", 1), (304, "x" * 300_000, "en", "c", 1)]
    rows += [(305, "été ß <|endoftext|> 日本\x1c語 \x85", "fr", None, 1)]
    rows += [(306, f"{shared} again {shared}", "en", "b", 1)] * 3
    rows += [(None, "no id " + shared, "en", "b", 1), (None, text_of(rng, 9), None, "b", 1), (307, "", None, "", None)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """``odd_rows`` with extra columns whose names operators use themselves."""
    extra = "ids binary, score double, shard int, slot long, size long, copies int, kept string, print long, held_out int"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    return spark.createDataFrame([(*r, *[None] * 9) for r in odd_rows], schema).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(spark):
    """A reader of the tables at scale 0.01."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
