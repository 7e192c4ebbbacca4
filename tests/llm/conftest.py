import pytest


@pytest.fixture
def docs(spark):
    """Rows of documents with an extra column whose name clashes with internal and result names."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", shard string, key string" if extra else "")
        whole = [(i, t, "en", "s", None if t is None else len(t)) + (("x", "y") if extra else ()) for i, t in rows]
        return spark.createDataFrame(whole, schema)

    return make


#: Nulls, empty texts, repeated rows, odd white space, long words, other scripts, special strings.
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b \n c"), (4, "a  b \n c"), (None, "no id here"), (5, "<|endoftext|> x <|endoftext|>"), (6, "日本語 テキスト 😀 é"),
    (7, "x" * 5000), (8, "the end. " * 700), (9, "\x00\x1c\x85 z"), (10, "▁a ▁▁ b"), (11, "\r\n\ttab  two"), (12, "don't I'll we've 12 345 !? ..."),
    (13, "Straße Éeux çle naïve ſſ"), (None, None), (14, " lead"), (15, "trail "), (16, "\n"), (17, "<s> </s> <0x41> <unk>"),
]
