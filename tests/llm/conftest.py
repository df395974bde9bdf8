import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SOUNDS = "al be ga del om sig kap lam the zet riv ston clo for sil win gar mar let ver ana iso uno ike por tes qui hal ned wyr".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SOUNDS) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with exact and near copies, repeated passages, odd texts, nulls in every column, repeated rows and ties."""
    rng = random.Random(5)
    rows = []
    passage = prose(rng, 30)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(40)]
    for i, t in enumerate(base):
        rows.append((i, t, rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s10"]), len(t)))
    for i in range(40, 60):  # near copies
        words = base[i % 7].split()
        words[rng.randrange(len(words))] = "changed"
        t = " ".join(words)
        rows.append((i, t, "en", "s1", len(t)))
    for i in range(60, 70):
        rows.append((i, base[3], "en", "s2", len(base[3])))
    for i in range(70, 80):
        t = prose(rng, 20) + " " + passage + " " + prose(rng, 20)
        rows.append((i, t, "fr", None, len(t)))
    odd = ["", None, " \t\n ", "one", "A b", "a B", "ünïcödé wörds ñ 漢字 🙂", "x" * 5000, "ab " * 2000, "line\nline\nline\nother\n" * 20, prose(rng, 20_000), "#*$%&|<> !!"]
    for i, t in enumerate(odd):
        rows.append((100 + i, t, None, "s2", None))
    rows.append((200, base[5], None, None, None))
    rows.append((200, base[5], None, None, None))  # repeated row
    rows.append((None, base[6], "en", "s1", 3))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with what operators add."""
    df = spark.createDataFrame(corpus, SCHEMA).repartition(5, F.col("n_chars"))
    return df.withColumns({c: F.lit("clash") for c in ("kept", "score", "size", "n_words", "n_tokens", "copies", "media", "lang_pred", "predicted", "component_id", "n_bytes", "batch", "target")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def folder(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)
