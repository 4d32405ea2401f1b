"""Awkward documents shared by the tests of the training-data operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, v int, k string, pos int, label string, y int, quality int, band string, spans string"


def sentence(n: int, salt: str = "") -> str:
    return " ".join(f"w{salt}{i * 7919 % 1000}x{i}" for i in range(n))


def odd_rows():
    """Nulls, empties, a very long text, ties and repeated rows, near copies and a shared passage."""
    base, passage = sentence(120, "a"), sentence(60, "p")
    texts = [
        (1, base), (2, base), (3, base + " tail"), (4, "one two three " + passage + " end"), (5, sentence(30, "b") + " " + passage), (6, None), (7, ""), (8, "   \n\t "), (9, "short"), (9, "short"),
        (10, "a a a a a a a a a a " * 20), (11, "a a a a a a a a a a " * 20), (None, base), (None, None), (12, sentence(20000, "long")), (13, "😀 ümlaut ñandú 漢字 текст"), (14, sentence(49, "q")), (15, sentence(49, "q")),
    ]
    return [(i, t, "en" if (i or 0) % 3 else None, None if (i or 0) % 4 == 0 else "s", len(t) if t else None, 1, "k", 2, "l", 0, 1, "b", "s") for i, t in texts]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def write(df, path, **others):
    """A folder of tables with these documents."""
    df.write.parquet(f"{path}/documents.parquet")
    for name, t in others.items():
        t.write.parquet(f"{path}/{name}.parquet")
    return str(path)
