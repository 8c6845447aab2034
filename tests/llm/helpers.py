"""Small tables for the operators: every odd row the contracts name."""

LONG = "the quick thing and another word over there " * 12_000  # over half a million characters
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component string, sig string, key string"


def odd_rows():
    """Null, empty, blank, sign-only and very long texts, copies, repeated rows and a null id."""
    texts = [None, "", " \n\t ", "!!! ...", "one", "one two three four", "a b c d e f g h", "A B C D E F G H", LONG, "é́ Ωσς 日本語 テキスト 🙂", "x" * 9000]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(3, "!!! ..."), (6, "a b c d e f g h"), (50, "a b c d e f g h"), (None, "a null id has a text of its own here"), (None, None)]
    return rows


def odd_docs(spark):
    """The odd rows, with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, None if k == 1 else "en", "s", 0, 1.0, "c", "s", "k") for k, t in odd_rows()], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
