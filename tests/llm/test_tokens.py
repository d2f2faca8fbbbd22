import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import tokens

ENCODERS = {"byte": tokens.byte_bpe(P.path("byte_bpe_50k.json")), "word": tokens.word_bpe(P.path("word_bpe_49k.json"))}
LETTERS = st.text(st.sampled_from(list("aAbé ßİñ'’.,1²½_-\n\t\r  　́ẞΣσ日😀<|>")), max_size=40)


@pytest.mark.parametrize("name", ENCODERS)
@settings(deadline=None, max_examples=300)
@given(text=LETTERS)
def test_pieces_give_the_ids_of_the_whole_text(name, text):
    assert list(ENCODERS[name].batches([text])) == [ENCODERS[name]._whole(text)]


@pytest.mark.parametrize("name", ENCODERS)
def test_special_tokens_and_long_words(name):
    texts = ["<|endoftext|> foo<|endoftext|>bar", "x" * 500 + " y", None, "", "it's I'LL don't"]
    assert list(ENCODERS[name].batches(texts)) == [ENCODERS[name]._whole(t) if t else b"" for t in texts]
