import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ability_engine.llm.tokens import PIECES, Encoder

ENCODERS = {name: Encoder(name, memo=50) for name in PIECES}
MIX = "aBé ÀzZ'sst're\n\t  \xa0  09²½#*$%.,!?_-ß\x1c\x85œİΣ́µªeïÿ×÷<|endoftext|>"


@pytest.mark.parametrize("name", sorted(PIECES))
@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=MIX, max_size=80) | st.text(max_size=40))
def test_pieces_give_the_tokenizers_ids(name, text):
    assert ENCODERS[name].encode(text) == ENCODERS[name].whole(text)


@pytest.mark.parametrize("name", sorted(PIECES))
def test_empty(name):
    assert ENCODERS[name].encode(None) == ENCODERS[name].encode("") == b""
