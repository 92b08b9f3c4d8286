"""Tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

LONG = "word%d " * 2000 % tuple(range(2000))
TEXTS = [None, "", " \n\t ", "one", "two words", LONG, "Same text here, the very same text in two rows of the table. Again and again.", "Same text here, the very same text in two rows of the table. Again and again."]


def documents(spark, texts=TEXTS, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", "s", 0, 7, "x", b"d") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int, digest string, `key` binary")


def strange(spark):
    """Edge texts, a repeated row and two rows without an id."""
    df = documents(spark, [*TEXTS, TEXTS[-1], "no id", None], [*range(len(TEXTS)), len(TEXTS) - 1, None, None])
    return df


def empty(spark):
    return documents(spark).limit(0)
