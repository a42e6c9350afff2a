import public_tokenizers
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def pieces():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def odd_texts():
    return [
        (1, "Hello world, this is plain text."),
        (2, None),
        (3, ""),
        (4, "   \n\n\t  "),
        (5, "word " * 30_000),
        (6, "x" * 70_000),
        (7, "Tabs\tand  double  spaces <|endoftext|> and ▁marks▁ <s> </s> ﬁ é 日本語 \U0001f600"),
        (1, "Hello world, this is plain text."),
        (None, "a row without an id"),
        (8, "café " * 3 + "\x00 end"),
    ]
