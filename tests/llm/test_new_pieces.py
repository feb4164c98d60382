"""New words of a slice go to the model side by side, with the library's ids."""

import random

from tokenizers import Tokenizer

from tallyfield.llm import tokens

SIGNS = [*"ab's'tve12.,!\n\t\xa0 \x85\x1cé🙂日#<|", "<|endoftext|>", "'ll", "word", "ing", " ", " ", " "]


class Counting:
    """The model, and how often it was asked for one piece."""

    def __init__(self, model):
        self.model, self.asked = model, 0

    def tokenize(self, text):
        self.asked += 1
        return self.model.tokenize(text)


def test_words_are_not_asked_one_by_one():
    e = tokens.Encoder(tokens.default_tokenizer())
    e.model = Counting(e.model)
    draw = random.Random(1)
    text = "".join(f" {''.join(draw.choices('abcdefghé', k=9))}{draw.choice(['', ',', '.'])}" for _ in range(5000))
    assert e.encode([text])[0].tolist() == Tokenizer.from_file(tokens.default_tokenizer()).encode(text, add_special_tokens=False).ids
    assert e.model.asked < 50


def test_odd_texts_and_full_memos_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(tokens, "PIECES_AT_ONCE", 7)
    e, fresh, draw = tokens.Encoder(tokens.default_tokenizer()), Tokenizer.from_file(tokens.default_tokenizer()), random.Random(2)
    for _ in range(100):
        texts = ["".join(draw.choices(SIGNS, k=draw.randrange(60))).replace("  ", " ") for _ in range(20)]
        for text, ids in zip(texts, e.encode(texts), strict=True):
            assert ids.tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_words_in_use_outlive_a_full_memo(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 20_000)
    e = tokens.Encoder(tokens.default_tokenizer())
    for i in range(40):
        e.encode([f"common words {' '.join(f'x{i}y{j}' for j in range(30))}"])
        assert " words" in e.memo
        assert len(e.memo) + len(e.old) < 400


def test_spaces_inside_white_space():
    e, text = tokens.Encoder(tokens.default_tokenizer()), "e!a \u2003 \xa0 \xa0\u3000 \x1f'll"
    assert e.encode([text])[0].tolist() == Tokenizer.from_file(tokens.default_tokenizer()).encode(text, add_special_tokens=False).ids
