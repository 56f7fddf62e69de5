"""Fixtures that every operator of the subpackage is tried on."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size long, text2 string, n long, hash long"


def documents(spark, texts, ids=None):
    """A documents table with columns of clashing names beside its own."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, ["en", "de", None][k % 3], ["a", "b", None][k % 3], None, "x", 1, None, 2, 3) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


ODD_TEXTS = [None, "", " ", "\n\t", "a", "two words", "naïve ünïcode – 你好 🎉", "\x00\x01\x1f", "same text here", "same text here", "<|endoftext|>", "x" * 5000, "long word " * 20000, "don't  stop\r\n  123 it's", "   odd spaces"]
