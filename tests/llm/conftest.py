import tempfile

import pytest

ODD = [
    (1, "", "en", "a"), (2, None, None, None), (3, "One two three four five.\nOne two three four five.", "en", "a"), (4, "One two three four five.\nOne two three four five.", "de", "b"),
    (4, "One two three four five.\nOne two three four five.", "de", "b"), (5, "mail a@b.com%x@y.z, +1 (555) 010-99-88 é 4111 1111 1111 1111 and 1.2.3.4.5 😀", "fr", "a"),
    (6, "Released under the MIT License. Licensed under CC BY-NC 4.0. <|endoftext|> ▁x  y\t\x1cz", "en", None), (None, "no id", "en", "a"), (7, "word " * 30_000, "en", "c"),
    (8, " ".join(f"w{i}" for i in range(20_000)), "en", "c"), (9, "x" * 40_000, "en", "c"), (10, "   \n\t ", "en", "c"), (11, "日本語 テスト текст İK", "xx", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeats, and columns whose names clash with the operators' own."""
    rows = [(*r, len(r[1]) if r[1] else None, "extra", 1, "w", 2.0) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, fp int, words string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def odd_dir(odd, spark):
    d = tempfile.mkdtemp(prefix="spark-odd-")
    odd.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d
