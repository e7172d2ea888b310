"""The piece encoder: what it holds and what it gives, against the library on whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkgrove.llm import vocab

WORD_BPE, BYTE_BPE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
#: Letters that lose or change their case in odd ways, marks that join the letter before them, contractions, signs, digits, blanks.
PARTS = [*"abIKSTz\xe9\xc9\xdf\xff\xaa\xba\xb5\xd7\xf7İıſςΣАя京가K", "̀", "̇", "́̄", "̸", "̀s", "'s", "'LL", "'", "’s",
         *"#.,-_<=>~|/@(", "0", "19", *" \n\t\xa0\x85 ", "\r\n", "\x1f", "é", "THE ", "Stra\xdfe", "가"]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
@pytest.mark.parametrize("plain", [False, True])
def test_ids_are_those_of_whole_texts(path, plain):
    tokenizer, rnd = Tokenizer.from_file(path), random.Random(9)
    tokenizer.encode_special_tokens = plain
    texts = ["".join(rnd.choices([*PARTS, "<|endoftext|>", "<|ENDOFTEXT|>"] if k % 9 == 0 else PARTS, k=rnd.randint(1, 30))) for k in range(6000)]
    got = vocab.PieceEncoder(path, plain).encode([x.encode() for x in texts])
    for text, ids in zip(texts, got):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_word_is_held_once_whatever_its_case_and_signs():
    encoder = vocab.PieceEncoder(WORD_BPE)
    encoder.encode([b"Word word WORD word, word### (word) Word's"])
    held = {encoder.cache.bytes[a : a + n].tobytes() for a, n in zip(encoder.cache.byte_starts[: encoder.cache.count], encoder.cache.byte_sizes)}
    assert held == {b"word", b",", b"###", b"(word", b")", b"'s"}


def test_lower_case_words_go_to_the_model_at_once(monkeypatch):
    encoder, passed = vocab.PieceEncoder(WORD_BPE), []
    modelled = encoder._modelled
    monkeypatch.setattr(encoder, "_modelled", lambda words: passed.extend(words) or modelled(words))
    text = "The größte Wörter naïve 京 abc1"
    ids = encoder.encode([text.encode()])[0].tolist()
    assert sorted(passed) == sorted(["the", "größte", "wörter", "naïve"]) and ids == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_spaced_words_go_to_the_model_at_once(monkeypatch):
    encoder, passed = vocab.PieceEncoder(BYTE_BPE), []
    modelled = encoder._modelled
    monkeypatch.setattr(encoder, "_modelled", lambda words: passed.extend(words) or modelled(words))
    text = "The gr\xf6\xdfte W\xd6RTER## 京 abc1"
    ids = encoder.encode([text.encode()])[0].tolist()
    assert sorted(passed) == sorted(["The", " gr\xf6\xdfte", " W\xd6RTER"]) and ids == encoder.tokenizer.encode(text, add_special_tokens=False).ids
