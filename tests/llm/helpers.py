"""Small corpora with the odd cases, and the real one at sf0.001."""

import random

SF = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, row string, score int, k1 string, `key` string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns with clashing names."""
    rng = random.Random(3)
    long = " ".join(words(rng, 30_000, 5000))
    base = " ".join(words(rng, 80))
    texts = [None, "", "   \n\t ", "one", "two words", base, base, base + " more", long, "été ß 漢字   x", "a\nb\na\n", "A@b.co 10.0.0.1 +1 555 123 4567", "\n".join([base] * 3)]
    rows = [(k, t, "en", "s1" if k % 2 else None, len(t or ""), "r", k, "x", None) for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SHAPE)


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(k, t, "en", source, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
