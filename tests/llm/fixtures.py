"""Small tables of awkward rows for the operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, hits int"


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43, "x", 1),
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43, "x", 1),
        (2, "the quick brown fox jumps over the lazy dog", "en", "a", 43, None, 2),
        (3, None, "en", "a", None, "x", None),
        (4, "", None, None, 0, "x", 3),
        (5, " \t\n ", "fr", "b", 4, "x", 3),
        (6, long, "en", "b", len(long), "x", 4),
        (7, long, "en", "é", len(long), "x", 4),
        (None, "le chat est sur la table avec le chien", "fr", "b", 40, "x", 5),
        (8, "le chat est sur la table avec le chien", "fr", None, 40, "x", 5),
        (9, "one two", "en", "c", 7, "x", 6),
        (10, "ONE\x0btwo", "en", "c", 7, "x", 6),
        (11, "12 34 !!", "de", "c", 8, "x", 7),
        (-12, "déjà vu \U0001f600 MIT License", "fr", "c", 20, "x", 8),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
