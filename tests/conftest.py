import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corpusmill.session import fresh_path, local_session  # noqa: E402

# A made-up language: words are syllables strung together, sentences open with a capital.
ONSETS, VOWELS, CODAS = "b d f g k l m n p r s t v z".split(), "a e i o u".split(), ["", "", "", "n", "r", "s"]
LEXICON_SIZE = 180


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def path(spark):
    return fresh_path(spark, "test")


def lexicon(rng: random.Random) -> list[str]:
    def syllable() -> str:
        return rng.choice(ONSETS) + rng.choice(VOWELS) + rng.choice(CODAS)

    return ["".join(syllable() for _ in range(rng.choice((1, 2, 2, 3)))) for _ in range(LEXICON_SIZE)]


def word_lines(count: int, seed: int) -> list[str]:
    """Sentences in which early words of the lexicon are frequent."""
    rng = random.Random(seed)
    words = lexicon(rng)
    made = []
    for _ in range(count):
        picked = [words[int(LEXICON_SIZE * rng.random() ** 2)] for _ in range(rng.randint(12, 24))]
        made.append(f"{picked[0].capitalize()} {' '.join(picked[1:])}{rng.choice('.?!')}")
    return made


@pytest.fixture(scope="session")
def lines():
    return word_lines(2_500, 20)


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")


def id_documents(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "doc_id BIGINT, ids ARRAY<INT>")


@pytest.fixture(scope="session")
def fitted(spark, lines):
    """A vocabulary of 512 on the made-up sentences."""
    from pyspark.sql import functions as F

    from corpusmill.operators import fit

    docs = documents(spark, lines).withColumn("ordinal", F.col("doc_id"))
    return fit.fit(docs, 512).cache()


@pytest.fixture(scope="session")
def pieces(fitted):
    from corpusmill.sources.vocabulary import Pieces

    return Pieces.of(fitted)
