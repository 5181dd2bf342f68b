import numpy as np
import pytest

LANGS = {
    "en": "the of and to in that is was for on with as at by this from have are not but they which".split(),
    "de": "der die das und ist nicht mit von auf für ein eine den dem sich auch werden über bei nach".split(),
}


def prose(rng, lang, words):
    stems = LANGS[lang]
    out = []
    for i in range(words):
        w = stems[rng.integers(len(stems))] if rng.random() < 0.4 else "".join(stems[rng.integers(len(stems))] for _ in range(2))
        out.append(w + ("." if rng.random() < 0.1 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls, empty and blank texts, repeated rows and a very long text."""
    rng = np.random.default_rng(3)
    long = prose(rng, "en", 30_000)
    plain = prose(rng, "en", 120)
    return [
        (1, plain, "en", 0.5),
        (1, plain, "en", 0.5),
        (2, None, "en", None),
        (3, "", None, 1.0),
        (4, " \n\t ", "de", 1.0),
        (None, prose(rng, "de", 80), "de", 2.0),
        (5, long, "en", 3.0),
        (6, "one", "xx", 3.0),
        (7, prose(rng, "de", 90), "de", None),
        (8, "the " * 500, "en", None),
    ]


ODD_SCHEMA = "doc_id long, text string, lang string, `odd.name` double"


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, ODD_SCHEMA)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
