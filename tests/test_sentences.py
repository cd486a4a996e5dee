"""The rule sentencizer against a reader of tokens."""

import hashlib
import random
import unicodedata

import pytest

from gristmill.functions.text import ABBREVIATIONS, ENDS, rule_sentences
from gristmill.plans import registry

SF = "/root/testdata/sf0.001"
WHITE = {chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}


def kind(c):
    return unicodedata.category(c)


def punctuation(c):
    return kind(c)[0] == "P"


def ends_here(text, i):
    """Whether the mark at i ends a sentence, if it stands in the punctuation at the end of a word."""
    if text[i] in ENDS:
        return True
    if text[i] != "." or text[i + 1 : i + 2] == "." or (i and text[i - 1] == "."):
        return False
    before = text[:i]
    if not before:
        return False
    for a in ABBREVIATIONS:
        if before.endswith(a):
            at = before[: -len(a)][-1:]
            if not at or not (kind(at)[0] in "LN" or at == "."):
                return False
    last = before[-1]
    return kind(last) in ("Ll", "Nd", "Pe", "Pf") or last in "%\"'" or last in WHITE or (len(before) > 1 and kind(last) == kind(before[-2]) == "Lu")


def reader(text):
    """Sentences of a text: words one after the other, with the state whether an end was seen."""
    starts, seen, i, n = [], False, 0, len(text)
    while i < n:
        if text[i] in WHITE:
            i += 1
            continue
        j = i
        while j < n and text[j] not in WHITE:
            j += 1
        body = j  # the word without the punctuation at its end
        while body > i and punctuation(text[body - 1]):
            body -= 1
        if body > i:
            first = next(k for k in range(i, body) if not punctuation(text[k]))
            if seen:
                starts.append(first)
                seen = False
            for k in range(first, body):
                if text[k] == "." and k and k + 1 < body and kind(text[k - 1]) == "Ll" and kind(text[k + 1]) == "Lu":
                    starts.append(k + 1)
        if j < n and any(ends_here(text, k) for k in range(body, j)):
            seen = True
        i = j
    cuts = [0, *starts, n]
    parts = [text[a:b].strip("".join(WHITE)) for a, b in zip(cuts, cuts[1:])]
    return [p for p in parts if p]


KNOWN = [
    ("One two. Three four! five? six", ["One two.", "Three four!", "five?", "six"]),
    ("Dr. Who met Mr. X in the U.S. today. He left.", ["Dr. Who met Mr. X in the U.S. today.", "He left."]),
    ('He said "stop." (Then) he ran.', ['He said "stop." (', "Then) he ran."]),
    ("Pi is 3.14 about. See a.com now", ["Pi is 3.14 about.", "See a.com now"]),
    ("end.Next one", ["end.", "Next one"]),
    ("Well... it goes on. J. Smith", ["Well... it goes on.", "J. Smith"]),
    ("NASA. Then", ["NASA.", "Then"]),
    ("wow!yes no", ["wow!yes no"]),
    ("a.\n\nb. 5 c", ["a.", "b.", "5 c"]),
    ("", []), (" \n ", []), ("...", ["..."]),
]


def test_known(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(KNOWN)], "i int, t string")
    assert {r.i: r.s for r in df.select("i", rule_sentences("t").alias("s")).collect()} == {i: s for i, (_, s) in enumerate(KNOWN)}
    assert [reader(t) for t, _ in KNOWN] == [s for _, s in KNOWN]


def test_random(spark):
    r = random.Random(4)
    pieces = ["word", "Word", "AB", "J", "3", "%", ".", ".", "!", "?", "…", '"', "(", ")", "-", " ", " ", "\n", "Mr", "e.g", "é", "Ü", "’", "　", "+", "x.Y"]
    texts = ["".join(r.choices(pieces, k=r.randrange(30))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.s for x in df.select("i", rule_sentences("t").alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == reader(t), repr(t)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text is not None}
    got = {(r.doc_id, r.position): r.sentence_md5 for r in registry.QUERIES["rule_sentences"](spark, sf).collect()}
    assert got == {(d, i): hashlib.md5(s.encode()).hexdigest() for d, t in docs.items() for i, s in enumerate(reader(t))}
