import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, `count` int"


def words(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdeé") for _ in range(6)) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows, clashing columns."""
    rng = random.Random(5)
    base = [" ".join(words(rng, rng.choice([3, 20, 80, 200]))) for _ in range(30)]
    passage = " ".join(words(rng, 70))
    texts = list(base)
    texts += [base[1].upper().replace("É", "é"), base[1], base[2], None, "", "   \n", "one", "ONE", "É é", "x" * 5000]
    for i in range(12):
        w = base[3].split()
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [" ".join(words(rng, 90)) + " " + passage + " " + " ".join(words(rng, 90)) for _ in range(3)]
    texts.append(" ".join(words(rng, 30_000)))
    out = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", len(t or ""), i, 1) for i, t in enumerate(texts)]
    out.append(out[4])  # a repeated row
    out.append((None, base[5], None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
