"""Sub-words by pieces."""

import random

from gristmill.functions import tokens
from gristmill.plans.chunks import VOCABULARY

TOKENIZER = tokens.from_file(__import__("public_tokenizers").path(VOCABULARY))


def test_pieces_have_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 50)
    r = random.Random(7)
    bits = ["a", "word", "It's", "'s", "12", "_", "__x", "!", "...", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "᠎", " ", "​", " ", "　", "ż", "中文", "é", "é", "😀", "<|endoftext|>", "﻿", "½", "²", "٠"]
    texts = ["".join(r.choice(bits) + " " * (r.random() < 0.5) for _ in range(r.randrange(0, 25))) for _ in range(4000)]
    for i in range(0, len(texts), 100):
        assert TOKENIZER.encode(texts[i : i + 100]) == TOKENIZER._whole(texts[i : i + 100])


def test_each_distinct_piece_is_encoded_once(monkeypatch):
    seen, whole = [], tokens.FileTokenizer._whole
    monkeypatch.setattr(tokens.FileTokenizer, "_whole", lambda self, t: seen.extend(t) or whole(self, t))
    tokens._held(TOKENIZER.content).clear()
    TOKENIZER.encode(["one two two two", "one two"] * 50)
    TOKENIZER.encode(["one two"])
    assert sorted(seen) == [" two", "one"]
