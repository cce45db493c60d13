import random

import pytest

WORDS = "lorem ipsum dolor sit amet tempor labore magna aliqua quis nisi ut ex ea commodo irure velit esse cillum fugiat nulla sint culpa qui".split()


def prose(rng: random.Random, sentences: int) -> str:
    return " ".join(" ".join(rng.choices(WORDS, k=rng.randint(9, 16))).capitalize() + "." for _ in range(sentences))


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    """Plain texts, exact and near copies, shared passages, nulls, empty, blank and very long ones."""
    rng = random.Random(7)
    out: list[str | None] = [prose(rng, rng.randint(4, 9)) for _ in range(40)]
    passage = prose(rng, 6)
    for k in range(0, 12, 2):
        out.append(out[k])
        words = out[k].split(" ")
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
        out.append(f"{prose(rng, 5)} {passage} {prose(rng, 5)}")
    # Lengths around the thresholds: variants of one text with more and more words replaced.
    base = prose(rng, 12).split(" ")
    for k in range(1, 12):
        out.append(" ".join("x" if i < k else w for i, w in enumerate(base)))
    return [*out, None, None, "", "   ", "one", "one", "two words", "a b c", "A B C", "é" * 40, "word " * 9000, "y" * 30000]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3 + 5, t, "en", None if i % 7 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.repartition(5)


@pytest.fixture(scope="session")
def sf_dir(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i * 3 + 5, int(i % 3 > 0), 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)
