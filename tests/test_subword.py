"""Chunkers by sub-words against plain readers written from their descriptions, with a small vocabulary of odd merges."""

import hashlib
import json
import random

import pytest

from gristmill.functions.tokens import FileTokenizer, WordTokenizer, decoded, from_file, token_count, token_ids
from gristmill.operators import chunking, subword
from gristmill.plans import chunks as plans
from gristmill.plans import registry

SF = "/root/testdata/sf0.001"


def small(regex: bool) -> FileTokenizer:
    """Bytes and a few merges; without the regex they go across spaces, so counts don't add up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    symbols = [chr(b) for b in printable] + [chr(256 + i) for i in range(len(others))]
    merges = ["a b", "b a", "ab ab", "Ġ a", "a Ġ", "Ã ©", "Ġa b", "aĠ a", "ab a", "c Ġ", "cĠ c", ". Ġ", "Ġ x", "Ġx y", "Ġxy z", "z w", "y zw", "x yzw"]
    vocab = {s: i for i, s in enumerate(symbols)}
    vocab |= {m.replace(" ", ""): 256 + i for i, m in enumerate(merges)}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": regex}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}
    return FileTokenizer(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model}))


SMALL, REGEX = small(False), small(True)


def count(tok, text):
    return len(tok.encode([text])[0])


def texts(seed, n=60):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "b", "ab", " ", "  ", "c", "é", "日", "\n", ". ", "🙂", "! ", " xyz", "w"]) for _ in range(r.randrange(60))) for _ in range(n)]


def plain_prefix(tok, ids, limit):
    best = None
    for n in range(1, min(len(ids), limit) + 1):
        text = tok.decode([ids[:n]])[0].strip()
        if text and count(tok, text) <= limit:
            best = text, n
    return best


def plain_windows(tok, text, size, overlap):
    ids, at, out = tok.encode([text])[0], 0, []
    while at < len(ids):
        found = plain_prefix(tok, ids[at : at + size], size)
        out.append(found[0] if found else "")
        used = found[1] if found else min(size, len(ids) - at)
        if at + used >= len(ids):
            break
        at += max(used - overlap, 1)
    return out


def plain_packed(tok, parts, size):
    out, held = [], []
    for p in parts:
        if count(tok, p) > size:
            out += ([" ".join(held)] if held else []) + plain_windows(tok, p, size, 0)
            held = []
        elif held and count(tok, " ".join([*held, p])) > size:
            out.append(" ".join(held))
            held = [p]
        else:
            held.append(p)
    return out + ([" ".join(held)] if held else [])


def plain_broken(tok, parts, size, threshold, least):
    out, held, n = [], [], 0
    for i, p in enumerate(parts):
        if held:
            like = chunking.cosine(chunking.hashed_sentence_vector(parts[i - 1]), chunking.hashed_sentence_vector(p))
            more = count(tok, " " + p)
            if (like < threshold and n >= least) or n + more > size:
                out.append(" ".join(held))
                held, n = [], 0
            else:
                held.append(p)
                n += more
                continue
        held, n = [p], count(tok, p)
    return out + ([" ".join(held)] if held else [])


from tests.test_sentences import reader as parts_of  # noqa: E402


def test_the_small_vocabulary_is_as_odd_as_it_should_be():
    assert not SMALL.adds_up and REGEX.adds_up
    ids = SMALL.encode([" xyzw"])[0]
    assert [count(SMALL, SMALL.decode([ids[:n]])[0].strip()) for n in (1, 2)] == [3, 1]  # the longer prefix has fewer
    assert count(SMALL, "c c") == 1 and count(SMALL, "c") + count(SMALL, " c") == 3


@pytest.mark.parametrize("tok", [SMALL, REGEX])
@pytest.mark.parametrize("size,overlap", [(1, 0), (2, 1), (3, 5), (7, 2), (20, 19)])
def test_longest_prefixes(tok, size, overlap):
    for text in texts(size):
        ids = tok.encode([text])[0]
        want = plain_prefix(tok, ids, size)
        assert subword.longest_prefix(tok, ids, size) == (want or ("", min(size, len(ids))))
        got = list(subword.limited_windows(tok, ids, size, overlap))
        assert got == plain_windows(tok, text, size, overlap)
        assert all(count(tok, t) <= size for t in got)
        assert list(subword.limited_pieces(tok, text, size)) == plain_windows(tok, text, size, 0)


@pytest.mark.parametrize("tok", [SMALL, REGEX])
def test_packing_and_breaks(tok):
    for text in texts(3, 150):
        parts = parts_of(text)
        for size in (2, 6, 15):
            assert list(subword.packed(tok, parts, size)) == plain_packed(tok, parts, size)
            for threshold in (0.0, 0.3, 1.1):
                got = list(subword.broken(tok, parts, size, threshold, size // 2, chunking.hashed_sentence_vector, chunking.cosine))
                assert got == plain_broken(tok, parts, size, threshold, size // 2)


def test_strict():
    with pytest.raises(ValueError):
        list(subword.limited_windows(REGEX, REGEX.encode(["\n\n\n\n"])[0], 2, 0, strict=True))
    with pytest.raises(ValueError):  # a character of four bytes doesn't fit
        list(subword.limited_windows(REGEX, REGEX.encode(["🙂"])[0], 1, 0, strict=True))
    assert list(subword.limited_windows(REGEX, [], 2, 0, strict=True)) == []


def rows(df):
    return sorted((r.chunk_id, r.doc_id, r.chunk_index, r.text, r.token_count) for r in df.collect())


def as_rows(name, by_doc, tok):
    return sorted((f"{name}::{d}::{i}", str(d), i, t.strip(), count(tok, t.strip())) for d, ts in by_doc.items() for i, t in enumerate(ts) if t.strip())


def test_frames(spark):
    docs = dict(enumerate(texts(9, 40))) | {900: "", 901: None, 902: " \n ", 903: "ab " * 3000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "'x' as chunk_id", "1 as chunk_index", "2 as token_count", "'t' as title").repartition(3)
    held = {d: t for d, t in docs.items() if t is not None}
    for tok in (SMALL, REGEX):
        spec = {"type": "fixed", "name": "f", "size": 6, "overlap": 2}

        def windows(ids):
            ends = [i for i in range(0, len(ids), 4) if i == 0 or i + 2 < len(ids)]
            return tok.decode([ids[i : i + 6] for i in ends])

        assert rows(subword.build_chunks(df, spec, tok)) == as_rows("f", {d: windows(tok.encode([t])[0]) for d, t in held.items()}, tok)
        assert rows(subword.build_chunks(df, {**spec, "limit": True}, tok)) == as_rows("f", {d: plain_windows(tok, t, 6, 2) for d, t in held.items()}, tok)
        got = rows(subword.build_chunks(df, {"type": "sentence", "name": "s", "size": 9, "limit": True}, tok))
        assert got == as_rows("s", {d: plain_packed(tok, parts_of(t), 9) for d, t in held.items()}, tok) and all(r[-1] <= 9 for r in got)
        got = rows(subword.build_chunks(df, {"type": "semantic", "name": "m", "size": 30, "threshold": 0.2, "least": 4}, tok))
        assert got == as_rows("m", {d: plain_broken(tok, parts_of(t), 30, 0.2, 4) for d, t in held.items()}, tok)
        got = rows(subword.build_chunks(df, {"type": "recursive", "name": "r", "size": 8, "overlap": 3, "limit": True}, tok))
        want = {d: [w for p in chunking.recursive_split(t, 8, 3, length=lambda x: count(tok, x)) for w in plain_windows(tok, p, 8, 0)] for d, t in held.items()}
        assert got == as_rows("r", want, tok) and all(r[-1] <= 8 for r in got)
        c = {(r.doc_id, r.position): (r.sentence, r.first, r.continuation) for r in subword.sentence_counts(df, tok).collect()}
        assert c == {(str(d), i): (s, count(tok, s), count(tok, " " + s) if i else 0) for d, t in held.items() for i, s in enumerate(parts_of(t))}
    with pytest.raises(ValueError):
        subword.build_chunks(df, {"type": "nope"}, REGEX)


def test_columns(spark):
    df = spark.createDataFrame([("a b a", 1), (None, 2), ("", 3), ("zz b", 4)], "t string, i int")
    tok = WordTokenizer(["a", "b"])
    got = {r.i: (r.ids, r.n, r.back) for r in df.select("i", token_ids("t", tok).alias("ids")).join(df.select("i", token_count("t", tok).alias("n")), "i").select("i", "ids", "n", decoded("ids", tok).alias("back")).collect()}
    assert got == {1: ([0, 1, 0], 3, "a b a"), 2: (None, None, None), 3: ([], 0, ""), 4: ([2, 1], 2, "? b")}
    assert rows(subword.build_chunks(df.selectExpr("i as doc_id", "t as text"), {"type": "fixed", "name": "w", "size": 2, "overlap": 0, "limit": True}, tok))[0][3] == "a b"


@pytest.fixture(scope="module")
def held(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None}


def digests(name, by_doc, tok):
    return sorted((f"{name}::{d}::{i}", str(d), i, count(tok, t.strip()), hashlib.md5(t.strip().encode()).hexdigest()) for d, ts in by_doc.items() for i, t in enumerate(ts) if t.strip())


@pytest.mark.parametrize("name", ["fixed_128", "fixed_254", "recursive_254", "sentence_254", "semantic_254"])
def test_queries(spark, held, name):
    tok = plans.tokenizer()
    size = int(name.split("_")[1])
    cut = {
        "fixed": lambda t: plain_windows_fast(tok, t, size, 19 if size == 128 else 38),
        "recursive": lambda t: [w for p in chunking.recursive_split(t, size, 38, length=lambda x: count(tok, x)) for w in plain_windows_fast(tok, p, size, 0)],
        "sentence": lambda t: plain_packed(tok, parts_of(t), size),
        "semantic": lambda t: plain_broken(tok, parts_of(t), size, 0.2, size // 2),
    }[name.split("_")[0]]
    got = registry.QUERIES[f"subword_{name}"](spark, SF).collect()
    want = digests(name, {d: cut(t) for d, t in held.items()}, tok)
    assert sorted((r.chunk_id, r.doc_id, r.chunk_index, r.token_count, r.text_md5) for r in got) == want
    assert name == "semantic_254" or max(r.token_count for r in got) <= size


def plain_windows_fast(tok, text, size, overlap):
    """As plain_windows, from the longest length down."""
    ids, at, out = tok.encode([text])[0], 0, []
    while at < len(ids):
        n = min(size, len(ids) - at)
        while n and (not (t := tok.decode([ids[at : at + n]])[0].strip()) or count(tok, t) > size):
            n -= 1
        out.append(t if n else "")
        n = n or min(size, len(ids) - at)
        if at + n >= len(ids):
            break
        at += max(n - overlap, 1)
    return out


def test_count_queries(spark, held):
    tok = plans.tokenizer()
    assert {r.doc_id: r.tokens for r in registry.QUERIES["subword_counts"](spark, SF).collect()} == {d: count(tok, t) for d, t in held.items()}
    got = {(r.doc_id, r.position): (r.first, r.continuation) for r in registry.QUERIES["subword_sentence_counts"](spark, SF).collect()}
    assert got == {(str(d), i): (count(tok, s), count(tok, " " + s) if i else 0) for d, t in held.items() for i, s in enumerate(parts_of(t))}
