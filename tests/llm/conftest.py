"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

from docspark.llm.common import documents

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, start long, _kept long, label int, id string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if k % 9 == 8 else w for k, w in enumerate(words))


def rows() -> list[tuple]:
    base = prose(1, 120)
    lines = [prose(k, 12) for k in range(2, 8)]
    texts = [
        base, base, base.replace("a", "A", 3), prose(9, 400), None, "", "   \n\t ", "one two", "one two", "Ünïcode text — with ✓ marks and 𝒜 beyond",
        "\n".join(lines), "intro here\n" + "\n".join(lines[1:5]) + "\noutro there", "\n".join(lines[:2] * 3), prose(10, 60) + " " + prose(11, 40), prose(12, 50) + " " + prose(11, 40),
        "token = abcdefgh1 and AKIA" + "Z" * 16 + " and " + "0123456789abcdef" * 2, "word " * 300, "### $$$ %%% " * 20, prose(13, 5000), "password: x",
    ]
    out = [(k, t, "en", "hot" if k % 3 else None, None if t is None else len(t), 7, 7, 7, 1, "x") for k, t in enumerate(texts)]
    return [*out, out[0], out[3], (99, base, None, "z", len(base), None, None, None, None, None)]


ITEMS = [(1, "one two WORD"), (2, None), (3, ""), (4, "no such terms zzzzz"), (4, "Ünïcode word word, and two"), (None, "marks of " + prose(9, 30)), (5, prose(1, 60))]
INF, NAN = float("inf"), float("nan")


def vectors() -> list[tuple]:
    rng = random.Random(4)
    own = [(k, [rng.gauss(0.1 * j, 1.0 + j) for j in range(20)], "x") for k in range(60)]
    bad = [(90, None, "x"), (91, [], "x"), (92, [None] * 20, "x"), (93, [NAN] * 20, "x"), (94, [1.0] * 19 + [INF], "x"), (95, [1.0, 2.0], "x"), (96, [1e30] * 20, "x")]
    return [*own, own[3], (None, own[4][1], None), (3, own[5][1], "x"), *bad]


VECTORS = "vec_id long, embedding array<float>, x string"


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    """The folder of the awkward tables."""
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(), KIND).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (9, 0, 1), (None, 1, 0), (3, None, None), (500, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(vectors(), VECTORS).repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    """The folder of the same tables without rows."""
    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], KIND).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], VECTORS).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return documents(spark, corpus)
