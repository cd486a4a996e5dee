"""Windows by the pieces at their ends, and the faster library, against the tokenizer's own library alone."""

import random

from gristmill.functions import tokens
from gristmill.operators import subword
from gristmill.plans.chunks import VOCABULARY

TOKENIZER = tokens.from_file(__import__("public_tokenizers").path(VOCABULARY))
BITS = ["a", "word", "It's", "'s", "12", "__x", "!", "...", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "ż", "中文", "é", "😀", "<|endoftext|>", "½", " the", " of", "Anblewh"]


class Library:
    adds_up = True
    own = tokens._loaded(TOKENIZER.content)

    def encode(self, texts):
        return [e.ids for e in self.own.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids):
        return self.own.decode_batch(ids, skip_special_tokens=True)


def texts(n, longest):
    r = random.Random(5)
    return ["".join(r.choice(BITS) + " " * (r.random() < 0.5) for _ in range(r.randrange(longest))) for _ in range(n)]


def test_windows_as_by_the_library_alone():
    own, found = Library(), 0
    for text in texts(400, 40):
        for size, overlap in ((1, 0), (3, 1), (9, 3)):
            want = [(t, len(own.encode([t])[0])) for t in subword.limited_windows(own, own.encode([text])[0], size, overlap)]
            assert list(subword.windows_of(TOKENIZER, text, size, overlap)) == want
            found += len(want)
    assert found > 10_000


def test_whole_windows_are_not_encoded(monkeypatch):
    """Only pieces at the ends are: 254 ids a window would be most of 1,000 characters."""
    seen, encode = [], tokens.FileTokenizer.encode
    text = " ".join(texts(1, 40)) + " plain words of a long text" * 400
    monkeypatch.setattr(tokens.FileTokenizer, "encode", lambda self, t: seen.extend(t) or encode(self, t))
    assert len(list(subword.windows_of(TOKENIZER, text, 254, 38))) > 5
    assert seen[0] == text and max(map(len, seen[1:])) < 50


def test_long_texts_and_decoding_as_by_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 100)
    own, r = Library(), random.Random(3)
    all_texts = [*texts(300, 200), "no space" * 50, "many plain words " * 30]
    assert TOKENIZER.encode(all_texts) == own.encode(all_texts)
    ids = [[r.randrange(256 if r.random() < 0.7 else 50257) for _ in range(r.randrange(1, 9))] for _ in range(3000)]
    assert TOKENIZER.decode(ids) == own.decode(ids)


def test_long_pieces_are_not_held():
    tokens._held(TOKENIZER.content).clear()
    TOKENIZER.encode(["中" * 5000 + " word"])
    assert list(tokens._held(TOKENIZER.content)) == [" word"]


def test_a_second_object_of_a_content_is_as_fast():
    """Workers get a new object for each query; its content must not be compared with the known one for each text."""
    import pickle
    import time

    again = pickle.loads(pickle.dumps(TOKENIZER))
    again.encode(["a"])
    began = time.perf_counter()
    for _ in range(2000):
        again.encode([" word"])
    assert time.perf_counter() - began < 0.1
