"""Random texts: the codec against the library, escapes, images and the automaton's words."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import bpe, chat, media, op3, stats, words

ALPHABET = st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'aAeéßİΣ1.,<|>[/]\\sINST\x1c\x85 ́"))
TEXT = st.text(ALPHABET, max_size=60)


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return bpe.Codec(op3.vocabulary(), leaf=8), Tokenizer.from_file(op3.vocabulary())


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_codec(both, texts):
    c, plain = both
    ids, at = c.batch(pa.array(texts))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
    assert c.decode_batch(ids, at).to_pylist() == [plain.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=4))
def test_chat_is_reversible(turns):
    roles, texts = (chat.escape(pa.array([t[k] for t in turns])).to_pylist() for k in (0, 1))
    line = chat.BEGIN + "".join(f"{chat.OPEN}{r}{chat.CLOSE}{t}{chat.END}" for r, t in zip(roles, texts, strict=True))
    assert chat.parse(line) == turns


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_media_and_words(text):
    raw = text.encode()
    back = media.decode_png(media.encode_png(media.pad(raw)))
    assert back.rstrip(b"\xff") == raw and len(back) % media.SAMPLES == 0
    found, bounds = words.split_words(pa.array([text]))
    assert found.to_pylist() == [w.decode() for w in raw.split()] and bounds.tolist() == [0, len(found)]
    assert stats.statistics(pa.array([text]))["word_chars"][0] == sum(len(w.decode()) for w in raw.split())
