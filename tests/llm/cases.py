"""Small tables with the cases every operator must define, and plain Python counterparts."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=3, groups=12):
    """Texts with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "eins", "zwei", "été", "ñu", "mit", "license", "x1"]
    made = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(3, 60))
        made.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice([*words, f"w{rng.randrange(99)}"])
            made.append(rng.choice([" ", "\n", "  "]).join(copy))
    return made


def documents(spark):
    """Rows with nulls in every column, empty, blank and long texts, ties and repeated rows."""
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts())]
    n = len(rows)
    rows += [
        (n, None, None, None, None),
        (n + 1, "", "en", "src0", 0),
        (n + 2, " \t\n ", "en", None, 4),
        (n + 3, "one two", "en", "src1", 7),
        (n + 4, "ONE  two", "en", "src1", 8),
        (n + 5, "Long " * 30_000, "en", "src2", 150_000),
        (n + 6, "z" * 20_000, "en", "src2", 20_000),
        (None, "no id here at all", "en", "src3", 17),
        rows[0],
        rows[0],
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]
