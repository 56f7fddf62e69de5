import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arcframe.llm import tokencount

from .data import ODD_TEXTS, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60) | st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "don't 'S 's", " \n \r\n x", "½ ² ٣ १२"]), max_size=5))
def test_lookup_matches_the_library(parts):
    class Table:
        value = {"a": 1, " the": 1}

    text = "".join(parts)
    assert tokencount._two_tier(PATH, Table)([text]) == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]


def test_query_rows(spark):
    got = {r.doc_id: r for r in tokencount.count_tokens(documents(spark, ODD_TEXTS), PATH).collect()}
    for i, t in enumerate(ODD_TEXTS):
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)


def test_long_texts_are_matched_piecewise(monkeypatch):
    class Table:
        value = {}

    text = "Some words, 12 of them; don't count.\n\n  <|endoftext|> rest" * 50
    monkeypatch.setattr(tokencount, "LONG_TEXT", 100)
    monkeypatch.setattr(tokencount, "LONG_STEP", 7)
    assert tokencount._two_tier(PATH, Table)([text]) == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]


def test_full_caches_start_again(monkeypatch):
    class Table:
        value = {"a": 1}

    monkeypatch.setattr(tokencount, "CACHE_SIZE", 3)
    count = tokencount._two_tier(PATH, Table)
    texts = ["alpha beta gamma delta", "epsilon zeta", "alpha a beta"]
    assert [count([t])[0] for t in texts] == [len(LIBRARY.encode(t).ids) for t in texts]


def test_other_tokenizers(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, ["Some text, twice.", None, "naïve 你好"])
    whole = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, model).collect()} == {0: len(whole.encode("Some text, twice.")), 1: 0, 2: len(whole.encode("naïve 你好"))}
    words = public_tokenizers.path("word_bpe_49k.json")
    assert not tokencount.is_byte_level(words)
    assert tokencount.count_tokens(docs, words).where("n_tokens > 0").count() == 2


def test_empty_table(spark):
    assert tokencount.count_tokens(documents(spark, []), PATH).count() == 0
