import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, and columns with names that operators use themselves."""
    base = " ".join(f"word{i % 97}x{i % 13}" for i in range(120))
    near = base.replace("word5x5", "changed", 1)
    rows = [
        (1, base, "en", "s"), (2, base, "en", "s"), (3, near, "en", "s"), (4, base.replace(" ", "\n"), "en", None), (5, "", "de", "s"), (6, None, None, "s"), (7, " \t\n", "de", "s"),
        (8, "kurz und gut", "de", "t"), (8, "kurz und gut", "de", "t"), (None, "ein anderer Text ohne Nummer", "de", "t"), (None, base, None, None),
        (9, "the MIT License and the Apache\nLicense, GENERAL public license.", "en", "s"), (10, "Wort " * 30_000, "de", "s"), (11, "naïve 😀 日本語 " * 40, "fr", "s"), (12, "### $$$ " * 80, "en", "s"),
    ]
    rows += [(100 + i, f"alpha{i} beta{i * 7} " + " ".join(f"u{i}n{k}" for k in range(60)), ("en", "de")[i % 2], "s") for i in range(20)]
    rows = [(*r, len(r[1] or ""), 1, 2, 3, 4) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, digest int, quality int, shard int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
