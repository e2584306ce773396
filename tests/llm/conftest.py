import random

import pytest
from pyspark.sql import types as T

FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
#: Columns whose names the operators use themselves.
CLASHING = [("score", T.StringType()), ("fp", T.StringType()), ("size", T.StringType()), ("kind", T.StringType()), ("ids", T.StringType()), ("_mix", T.StringType())]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in FIELDS + CLASHING])
SYLLABLES = {"en": ["the", "and", "ing", "ther", "on", "sh"], "de": ["der", "ung", "sch", "ein", "keit", "ö"], "fr": ["eau", "que", "ment", "é", "la", "oi"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows():
    rng = random.Random(4)
    texts = [(prose(rng, lang, rng.randint(5, 80)), lang) for _ in range(14) for lang in SYLLABLES]
    passage = prose(rng, "en", 30)
    texts += [(f"{prose(rng, 'en', 8)} {passage} {prose(rng, 'de', 5)}", "en") for _ in range(6)]
    texts += [(texts[0][0], "en"), (texts[0][0], None), (None, "en"), ("", "fr"), ("   \n\t ", None), ("12 34 !!", "de"), ("a" * 3000, "en"), (prose(rng, "fr", 6000), "fr")]
    texts += [('say token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" now ' + prose(rng, "en", 10), "en"), ("Ünï ▁ <s> 🤖 \x1c <|endoftext|> x", "fr"), ("THE AND\rTHE\x0bAND", "en")]
    out = [(i, t, lang, ["b", "a", None, "é"][i % 4], None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    out += [(None, "no id at all", None, None, None), (None, texts[1][0], "en", "a", 3), out[3], out[3]]  # null ids, repeated rows
    return [(*r, "x", None, "y", "z", "w", "v") for r in out]


@pytest.fixture(scope="session")
def documents():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
