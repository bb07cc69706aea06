"""Small tables for the tests of the operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **more):
    """Documents 0, 1, ... with these texts."""
    rows = [(i, t, more.get("lang", "en"), f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


#: Nulls, empty, blank, ties, repeats, odd characters, a very long text.
ODD = [None, "", " \n\t ", "one", "same text here now", "same text here now", "é日本🙂 ß", "x" * 70_000, "a b " * 9_000, "\x1c\x85  y", "l1\nl1\n\nl1", "tab\there\r\nand\x0bthere\x0cend"]


def odd_documents(spark):
    """The odd texts, with a null id, a repeated row and clashing extra columns."""
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else "s", None) for i, t in enumerate(ODD)]
    rows += [(None, "no id", None, None, None), (5, "same text here now", "en", "s", None), (5, "other text of five", "en", "s", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "'x' as n_tokens", "1 as n", "'k' as kept", "0 as node", "true as score")


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
