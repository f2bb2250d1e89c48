"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name long, level string, range int"


def prose(n, seed, words=400):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(words)]
    return " ".join(r.choice(vocab) for _ in range(n))


def rows():
    long_text = prose(60_000, 1, 5000)
    base = prose(200, 2)
    near = base.replace(" ", "  ", 3).split(" ")
    near[100] = "changed"
    texts = [
        (1, base, "en"), (2, base + " ", "en"), (3, " ".join(near), "en"), (4, "", "en"), (5, None, None), (6, "   \t\n", "de"),
        (7, long_text, "en"), (8, "x", "de"), (8, "x", "de"), (9, "one two three", "de"), (10, "One two  THREE", None), (None, base, "en"), (None, "solo", None),
        (11, "12345 !!", "en"), (12, "naïve café 你好 \x1c words é", "fr"), (13, long_text[:5000], "en"), (14, "a" * 70_000 + " b", "en"), (15, base, "en"),
    ]
    return [(i, t, lang, None if k % 5 == 0 else f"s{k % 3}", len(t or ""), k, "L", -k) for k, (i, t, lang) in enumerate(texts)]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
