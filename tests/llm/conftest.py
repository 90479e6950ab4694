import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, cls string, part string, g string"


@pytest.fixture
def make(spark):
    """Documents with extra columns whose names clash with those that operators use inside."""

    def run(rows):
        return spark.createDataFrame([(i, t, lang, "s", 0, "k", "c", "p", "g") for i, t, lang in ((*r, None)[:3] for r in rows)], SCHEMA)

    return run


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "a b c d"), (6, "a b c d"), (7, "x " * 50_000), (8, "été Über 中文 😀"), (9, "<|endoftext|>"), (10, None)]


@pytest.fixture
def odd(make):
    return make(ODD)


@pytest.fixture
def empty(make):
    return make([]).limit(0)
