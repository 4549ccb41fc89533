import random

import pytest

WORDS = [f"w{i}x" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents():
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared passages, blanks, nulls and repeats."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    texts = base + base[:5]  # exact copies
    for t in base[5:12]:  # near copies: one word in forty changes
        w = t.split()
        texts.append(" ".join("zz" if i % 40 == 7 else x for i, x in enumerate(w)))
    texts += [f"{prose(rng, 30)}\n{passage}\n\n{prose(rng, 20)}" for _ in range(6)]
    texts += [None, "", "   \n\t ", "one", "two words", "same same same", "A b C d E", "a B c D e", prose(rng, 6000), "x" * 30000, "é日本 ½ 😀\x1c ok\x85", "a" * 50 + " " + "ab" * 40]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t) if t is not None else None) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, base[0], None, None, None), (None, None, None, None, None)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 7 == 0)) for r in documents() if r[0] is not None], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path
