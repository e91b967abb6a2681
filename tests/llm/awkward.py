"""A small table with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, found int, `order` int, row int, part int, n int, _name string"
PASSAGE = " ".join(f"pass{i}" for i in range(60))
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(40_000))
BIG = 9007199254740993


def rows():
    texts = [
        (1, "", "en", "a"), (2, None, "en", "a"), (3, "   \t\n", "en", "b"), (4, "one", "en", "b"), (5, "one two", None, None),
        (6, f"start {PASSAGE} end", "en", "a"), (7, f"other {PASSAGE} tail", "en", "c"), (7, f"other {PASSAGE} tail", "en", "c"),
        (8, LONG, "en", "a"), (9, LONG + " more", "en", "a"), (BIG, "tie tie tie tie", "en", None), (BIG + 1, "tie tie tie tie", "en", "zz"),
        (None, f"nameless {PASSAGE}", "en", "a"), (None, None, None, None), (10, "the " * 300, "en", "a"), (11, "Élan naïve œuvre — ça va 漢字 😀", "fr", "é"),
        (12, "12 34 !! ??", "en", "a"), (7, "same id, other text", "en", "c"),
    ]
    return [(*t, len(t[1] or ""), "k", 5, 6, 7, 8, 9, "x") for t in texts]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
