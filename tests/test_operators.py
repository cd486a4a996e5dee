"""Operators against plain Python and stated numbers; edge cases and errors."""

import collections
import json
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from gristmill.functions import answers as A
from gristmill.functions import text as T
from gristmill.operators import chunking, dialogue, diagnostics, grading, integrity, retrieval, stats, supervision
from gristmill.sources import corpus, inventory, jsonl
from gristmill.streaming import ledger


def norm(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def f1(a, b):
    a, b = norm(a).split(), norm(b).split()
    if not a or not b:
        return float(not a and not b)
    n = sum((collections.Counter(a) & collections.Counter(b)).values())
    return 2 * n / (len(a) + len(b)) if n else 0.0


TEXTS = ["", "The A!", "a an the", "Über die Straße, the end.", "It's a test; isn't it?", "no change", "  spaced\tout\nlines ", "repeat repeat repeat other", "tHe cat sat", "naïve café the"]


def test_normalize_and_f1(spark):
    rows = [(i, j, a, b) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "i int, j int, a string, b string")
    for r in df.select("a", "b", T.normalize_text("a").alias("n"), T.token_f1("a", "b").alias("f")).collect():
        assert r.n == norm(r.a)
        assert math.isclose(r.f, f1(r.a, r.b), abs_tol=1e-12)


def test_null_text(spark):
    r = spark.createDataFrame([(None,)], "a string").select(T.normalize_text("a").alias("n"), F.size(T.lexical_tokens("a")).alias("t")).first()
    assert r.n is None


def test_grades(spark):
    df = spark.createDataFrame([("a big art show", "d1", ["d1"], ["Art"]), ("the start of it", "d2", ["d1"], ["art"]), ("nothing", "d1", ["d1"], ["x y"]), ("nothing", "d9", ["d1"], ["", "the"])], "t string, d string, g array<string>, s array<string>")
    got = df.select(T.evidence_grade("t", "d", F.col("g"), F.col("s")).alias("sub"), T.evidence_grade("t", "d", F.col("g"), F.col("s"), "token").alias("tok")).collect()
    assert [(r.sub, r.tok) for r in got] == [(2, 2), (2, 0), (1, 1), (0, 0)]
    with pytest.raises(ValueError):
        T.evidence_grade("t", "d", F.col("g"), F.col("s"), "other")


@pytest.mark.parametrize("grades,pool,legacy", [([1, 1, 1, 1, 2] + [0] * 15, 0.5615579549479297, 1.0), ([1, 1, 1, 1], 1.0, 1.0), ([0] * 20, 0.0, 0.0), ([2, 1, 0], 1.0, 1.0), ([2, 1, 1, 0, 0], 1.0, 1.0), ([2, 1], 1.0, 1.0)])
def test_ndcg(spark, grades, pool, legacy):
    df = spark.createDataFrame([(1, i + 1, g) for i, g in enumerate(grades)], "q int, rank int, grade int")
    assert math.isclose(grading.ndcg(df, ["q"]).first().ndcg, pool, abs_tol=1e-12)
    assert math.isclose(grading.ndcg(df, ["q"], pool=False).first().ndcg, legacy, abs_tol=1e-12)


def test_ndcg_refuses_bad_grades(spark):
    with pytest.raises(Exception, match="finite"):
        grading.ndcg(spark.createDataFrame([(1, 1, 1.0), (1, 9, -1.0)], "q int, rank int, grade double"), ["q"]).collect()
    with pytest.raises(ValueError):
        grading.ndcg(spark.createDataFrame([(1, 1, 1)], "q int, rank int, grade int"), ["q"], k=0)


def test_fixed_windows(spark):
    def want(w, size, overlap):
        out, stride = [], max(1, size - overlap)
        for s in range(0, len(w), stride):
            out.append(" ".join(w[s : s + size]))
            if s + size >= len(w):
                break
        return out

    for n in (0, 1, 5, 10, 11, 23):
        for size, overlap in ((5, 1), (5, 0), (4, 9), (30, 3)):
            w = [f"w{i}" for i in range(n)]
            df = spark.createDataFrame([("d", " ".join(w))], "doc_id string, text string")
            got = [r.text for r in chunking.fixed_chunks(df, size, overlap, "f").orderBy("chunk_index").collect()]
            assert got == want(w, size, overlap), (n, size, overlap)


def test_sentence_packing(spark):
    random.seed(1)
    text = " ".join(" ".join("w%d" % random.randrange(9) for _ in range(random.choice([1, 3, 12]))) + random.choice(".!?") for _ in range(40))
    df = spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "doc_id string, text string")
    rows = chunking.sentence_chunks(df, 8, "s").collect()
    assert " ".join(r.text for r in sorted(rows, key=lambda r: r.chunk_index)) == " ".join(text.split())
    assert all(r.token_count <= 8 and r.doc_id == "d" for r in rows)


def test_recursive_pieces():
    text = "one two three.\n\nfour five six seven eight nine ten. eleven\ntwelve " + "x" * 50
    pieces = chunking.recursive_split(text, 4, 0)
    assert all(len(p.split()) <= 4 for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())
    assert len(chunking.recursive_split(text, 4, 2)) >= len(pieces)


def test_semantic_breaks(spark):
    df = spark.createDataFrame([("d", "cat cat cat. cat cat cat. dog dog dog. dog dog dog.")], "doc_id string, text string")
    got = [r.text for r in chunking.semantic_chunks(df, 100, 0.2, "m", least=3).orderBy("chunk_index").collect()]
    assert got == ["cat cat cat. cat cat cat.", "dog dog dog. dog dog dog."]


def test_unknown_chunker(spark):
    df = spark.createDataFrame([("d", "x")], "doc_id string, text string")
    with pytest.raises(ValueError):
        chunking.build_chunks(df, {"type": "nope"})
    with pytest.raises(ImportError):
        chunking.build_chunks(df, {"type": "external_semantic"})


def bm25_plain(queries, chunks, k):
    toks = {c: re.findall(r"\w+", t.lower()) for c, t in chunks}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = collections.Counter(t for w in toks.values() for t in set(w))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    out = {}
    for q, text in queries:
        scored = []
        for c, w in toks.items():
            tf = collections.Counter(w)
            s = sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in re.findall(r"\w+", text.lower()) if tf[t])
            scored.append((-round(s, 9), c))
        out[q] = [c for _, c in sorted(scored)[:k]]
    return out


def test_bm25_and_fusion(spark):
    random.seed(2)
    chunks = [(f"c{i:02d}", " ".join(random.choice("red green blue cat dog sun moon sea".split()) for _ in range(random.randint(1, 12)))) for i in range(30)]
    queries = [(1, "red cat"), (2, "red red moon"), (3, "unknown words"), (4, "sea")]
    c, q = spark.createDataFrame(chunks, "chunk_id string, text string"), spark.createDataFrame(queries, "query_id int, text string")
    want = bm25_plain(queries, chunks, 7)
    got = collections.defaultdict(list)
    for r in retrieval.bm25(q, c, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    assert dict(got) == want
    lists = [spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int"), spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, rank int")]
    fused = [(r.chunk_id, r.score) for r in retrieval.fuse([(lists[0], 0.6), (lists[1], 0.4)], 3).orderBy("rank").collect()]
    assert [x for x, _ in fused] == ["b", "a", "c"]
    assert math.isclose(fused[0][1], round(0.6 / 62 + 0.4 / 61, 9))
    assert retrieval.retrieve("hybrid", q, c, 3).count() == 12 and retrieval.retrieve("rerank", q, c, 2).count() == 8
    with pytest.raises(ValueError):
        retrieval.retrieve("none", q, c, 1)


def test_dense(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8]), ("d", [0.6, 0.8])], "chunk_id string, vector array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, vector array<double>")
    assert [r.chunk_id for r in retrieval.dense(q, v, 3).orderBy("rank").collect()] == ["b", "c", "d"]
    assert retrieval.dense(q, v, 9).count() == 4


def test_family_keys(spark):
    r = spark.createDataFrame([(" SSA", "Benefits #12"), ("VA", "Benefits  x#3")], "d string, t string").select(dialogue.family_key(F.col("d"), F.col("t")).alias("a"), dialogue.family_key(F.col("d"), F.col("t"), True).alias("b")).collect()
    assert [tuple(x) for x in r] == [("ssa::benefits", "ssa::benefits"), ("va::benefits x", "va::benefits x#3")]


def test_inference_refuses_leaks(spark):
    t = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "Agent", "yo"), (1, 2, "user", "end")], "conv_id int, turn int, role string, text string")
    c = dialogue.cases(t)
    assert c.count() == 1 and "target_agent_response" not in dialogue.inference(c).columns
    with pytest.raises(ValueError):
        dialogue.inference(c.select(F.struct("target_agent_response").alias("x")))


def rows(spark, flip=False):
    data = [(1, "fixed_254", "c2", "d", 2, "The A!", 0), (1, "fixed_128", "c1", "d", 1, "a", 2), (1, "fixed_254", "c3", "d", 3, "Cat sat", 1), (1, "fixed_128", "c4", "d", 3, "the cat sat", 1), (1, "fixed_128", "c5", "d", 5, "dog", 0)]
    if flip:
        data = [(*r[:-1], 2 - r[-1]) for r in data]
    return spark.createDataFrame(data, "query_id int, chunker string, chunk_id string, doc_id string, fused_rank int, text string, grade int")


def test_dedup(spark):
    blind = sorted(r.chunk_id for r in supervision.dedup_label_blind(rows(spark)).collect())
    assert blind == sorted(r.chunk_id for r in supervision.dedup_label_blind(rows(spark, True)).collect()) == ["c1", "c4", "c5"]
    assert sorted(r.chunk_id for r in supervision.dedup_grade_first(rows(spark)).collect()) == ["c4", "c5"]


def test_groups_loss_draws(spark):
    g = supervision.listwise_groups(rows(spark), 2).collect()
    assert [(r.positive_chunk_id, r.negative_chunk_ids) for r in g] == [("c1", ["c2", "c3"])]
    s = spark.createDataFrame([(1, 0, 2.0), (1, 1, 0.0), (2, 0, 0.0), (2, 1, 1.0), (2, 2, -1.0)], "g int, position int, score double")
    assert math.isclose(supervision.listwise_loss(s, "g").agg(F.avg("loss")).first()[0], 0.7672669877436765, abs_tol=1e-12)
    d = supervision.epoch_draws(spark.range(7).withColumnRenamed("id", "g"), "g", 20, 20260904).orderBy("draw").collect()
    assert sorted(r.g for r in d[:7]) == sorted(r.g for r in d[7:14]) == list(range(7)) and len(d) == 20
    with pytest.raises(ValueError):
        supervision.epoch_draws(spark.range(0).withColumnRenamed("id", "g"), "g", 2, 1)
    ok = spark.createDataFrame([([1, 0, 0],), ([0, 1],), ([1],)], "l array<int>").select(supervision.positive_first(F.col("l")).alias("x")).collect()
    assert [r.x for r in ok] == [True, False, False]


def test_statistics(spark):
    data = [(i, f"f{i // 2}", f"d{i % 2}", 0.01 * ((i * 7) % 11 - 5)) for i in range(40)]
    df = spark.createDataFrame(data, "doc int, family string, domain string, v double")
    a = stats.sign_flip_p(df, "v", "family", 99, 5).first()
    b = stats.sign_flip_p(df.repartition(7), "v", "family", 99, 5).first()
    assert a.p == b.p and 0 < a.p <= 1
    ci = stats.interval(stats.bootstrap(df, "v", "family", "domain", 99, 5)).first()
    assert ci.low <= sum(r[3] for r in data) / 40 <= ci.high
    s = stats.summary(spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (10.0,), (None,)], "v double"), "v").first()
    assert (s.n, s["mean"], s["min"], s.median, s["max"]) == (3, 13 / 3, 1.0, 2.0, 10.0)
    flat = stats.associations(spark.createDataFrame([("x", 1.0, 2.0), ("x", 1.0, 3.0)], "k string, a double, b double"), "a", "b", ["k"]).first()
    assert flat.pearson is None and flat.spearman is None


ANSWERS = [
    ("How many acts?", "It has three acts (see passage 2).", "three acts"),
    ("When did it open?", "It opened on May 4, 1999.", "May 4, 1999"),
    ("Who wrote it?", "Jane Doe was the writer", "Jane Doe"),
    ("Where does it start?", "It runs from Lima to Cusco", "Lima"),
    ("Where is it?", "It is in the old town, near", "the old town"),
    ("Name it", "The house is owned by Bob", "Bob"),
    ("What is it?", "It is a big dog.", "big dog"),
    ("Say", "plain answer.", "plain answer"),
    ("Say", "unanswerable", "unanswerable"),
    ("Say", "  ", ""),
]


def test_answers(spark):
    df = spark.createDataFrame(ANSWERS, "q string, a string, want string")
    for r in df.select("want", A.compress_answer(F.col("q"), F.col("a")).alias("got")).collect():
        assert r.got == r.want
    raw = [(' Answer: "Yes." [3]', 'Yes."'), ('Answer: "Yes."', "Yes"), ("[1] The answer is 42.\nmore", "42"), ("It is not supported by it", "unanswerable"), ("", "")]
    assert [r.x for r in spark.createDataFrame(raw, "a string, w string").select(A.normalize_response(F.col("a")).alias("x")).collect()] == [w for _, w in raw]
    refine = [("over 3 million", False), ("one two three four", False), ("a: b", True), ("one two three four five six seven", True), ("it is a dog yes", True), ("five small words right here", False), ("unanswerable", False)]
    assert [r.x for r in spark.createDataFrame(refine, "a string, w boolean").select(A.should_refine(F.col("a")).alias("x")).collect()] == [w for _, w in refine]


def test_extractive(spark):
    c = "Title: x\n# The red fox jumped over.\n- Nothing to see here now. The fox was red and quick. Short one.\n\nOther words are all here."
    df = spark.createDataFrame([("Where is the red fox?", c), ("q", None), ("q", "")], "q string, c string")
    got = [r.x for r in df.select(A.extractive_answer(F.col("q"), F.col("c"), 2).alias("x")).collect()]
    assert got[1:] == [A.NO_CONTEXT, A.NO_CONTEXT]
    assert "red fox jumped" in got[0] and "The fox was red" in got[0] and "Nothing" not in got[0]


def test_prompt_hash_and_pack(spark):
    q = 'Is "it" so?'
    messages = [{"role": "system", "content": A.GROUNDED_SYSTEM}, {"role": "user", "content": A.GROUNDED_USER.format(q=q, c=A.CONTEXT_PLACE)}]
    import hashlib

    want = hashlib.sha256(json.dumps(messages, sort_keys=True).encode()).hexdigest()
    assert spark.createDataFrame([(q,)], "q string").select(A.prompt_hash(F.col("q")).alias("h")).first().h == want
    p = A.pack(F.col("t"), F.lit(3), 5)
    r = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>").select(*[c.alias(n) for n, c in p.items()]).first()
    assert (r.packed, r.full_tokens, r.used_tokens, r.truncated) == ("a b", 6, 5, True)


def test_keyed_store(spark, tmp_path):
    store = jsonl.KeyedStore(spark, str(tmp_path / "s"), ["key"])
    make = lambda *r: spark.createDataFrame(list(r), "key string, value int")
    assert store.append(make(("a", 1))) == {"append": 1, "skip": 0}
    assert store.append(make(("a", 1), ("b", 2))) == {"append": 1, "skip": 1}
    with pytest.raises(ValueError):
        store.append(make(("a", 2)))
    with pytest.raises(ValueError):
        store.append(make(("c", 1), ("c", 2)))
    assert store.read().count() == 2


def test_jsonl_hash(spark, tmp_path):
    df = jsonl.with_hash(spark.createDataFrame([("é\"x", 1, None), ("b", 2, "z")], "s string, n int, o string"))
    want = jsonl.sha256_of({"s": "é\"x", "n": 1, "o": None})
    assert df.where("n = 1").first().row_sha256 == want
    jsonl.write_once(df, str(tmp_path / "j"))
    assert jsonl.read_jsonl(spark, str(tmp_path / "j"), df.schema).where("row_sha256 is not null").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"s":"x","n":1,"o":null,"row_sha256":"00"}\n\n')
    with pytest.raises(Exception, match="hash"):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl"), df.schema).collect()
    jsonl.write_json_once(tmp_path / "m.json", {"a": 1})
    jsonl.write_json_once(tmp_path / "m.json", {"a": 1})
    with pytest.raises(RuntimeError):
        jsonl.write_json_once(tmp_path / "m.json", {"a": 2})


def test_budget_over_an_event_log(spark, tmp_path):
    now = [1000.0]
    log = ledger.EventLog(tmp_path / "log.jsonl", lambda: now[0])
    first = ledger.Budget(spark, log, 3600)
    assert first.used() == 0 and first.start("test") == 0
    now[0] += 100
    assert first.beat("test") == 100
    with pytest.raises(ledger.BudgetStop):
        first.beat("test", 4000)
    now[0] += 500  # the first never ends: it counts to its last word and the margin
    second = ledger.Budget(spark, log, 3600)
    assert second.start("again") == 160
    now[0] += 10
    assert second.end("again") == 170
    with pytest.raises(RuntimeError, match="no session"):
        second.beat("again")
    with pytest.raises(RuntimeError, match="ceiling"):
        ledger.Budget(spark, log, 1).start("x")
    lines = (tmp_path / "log.jsonl").read_text().splitlines()
    log.write("a", "note", n=1)
    assert (tmp_path / "log.jsonl").read_text().splitlines()[:-1] == lines and second.used() == 170
    rows = log.read(spark).collect()
    assert len({r.id for r in rows}) == len(rows) == 6 and rows[-1].details == {"n": "1"}


def test_semantic_cuts_as_a_greedy_reader_does(spark):
    """Sentences read one by one: a chunk is closed before a sentence that passes the size or is unlike the last one."""

    random.seed(5)
    text = " ".join(" ".join(random.choice("abcd") * 3 for _ in range(random.randint(1, 9))).capitalize() + "." for _ in range(120))
    docs = spark.createDataFrame([(1, text), (2, "One."), (3, ""), (4, None)], "doc_id long, text string")
    for size, least in ((20, 4), (12, 12), (3, 1)):
        got = [r.text for r in chunking.semantic_chunks(docs.where("doc_id = 1"), size, 0.7, "s", least).orderBy("chunk_index").collect()]
        parts = docs.where("doc_id = 1").select(T.sentences("text").alias("s")).first().s
        want, held = [], []
        for part in parts:
            count = sum(len(p.split()) for p in held)
            unlike = held and chunking.cosine(chunking.hashed_sentence_vector(held[-1]), chunking.hashed_sentence_vector(part)) < 0.7
            if held and (count + len(part.split()) > size or (unlike and count >= least)):
                want.append(" ".join(held))
                held = []
            held.append(part)
        assert got == [*want, " ".join(held)]
    assert chunking.semantic_chunks(docs.where("doc_id > 1"), 20, 0.7, "s").count() == 1


def test_gates(tmp_path):
    with pytest.raises(RuntimeError):
        ledger.gate({tmp_path / "none": "0"})
    with pytest.raises(ValueError):
        ledger.run_stage("s", lambda: (_ for _ in ()).throw(ValueError("x")), tmp_path)
    assert json.loads((tmp_path / "BLOCKED.json").read_text())["stage"] == "s"


def test_matrix(spark):
    e = spark.createDataFrame([(a, b) for a in "xy" for b in (1, 2)], "a string, b int")
    integrity.require_complete(e, ["a", "b"], e)
    with pytest.raises(ValueError, match="missing"):
        integrity.require_complete(e.where("not (a = 'x' and b = 2)"), ["a", "b"], e)
    with pytest.raises(ValueError, match="double"):
        integrity.require_complete(e.union(e), ["a", "b"], e)
    with pytest.raises(Exception, match="no match"):
        integrity.mandatory(e, e.where("b = 1").withColumn("v", F.lit(1)), ["a", "b"], "v").collect()


def test_inventory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("x,y\n1,2\n")
    inv = inventory.files(spark, str(tmp_path / "d"))
    import hashlib

    sha = hashlib.sha256(b"x,y\n1,2\n").hexdigest()
    assert inv.first().sha256 == sha
    assert inventory.identity_failures(spark.createDataFrame([("a.csv", sha), ("b.csv", sha)], "name string, sha256 string"), inv).count() == 1
    assert inventory.tree_hash(inv).first().files == 1
    assert "<td>&lt;</td>" in inventory.html_report({"t": "a\n<\n"}, "r")
    with pytest.raises(ValueError):
        inventory.html_report({"t": "a,b\n1\n"}, "r")
    assert inventory.private_fields(spark.createDataFrame([([("x", 1)],)], "a array<struct<text: string, n: int>>").schema) == ["a[].text"]
    (tmp_path / "bad.csv").write_text("x,y\n1,2,3\n")
    with pytest.raises(Exception):
        inventory.read_table(spark, str(tmp_path / "bad.csv")).collect()


def test_archives(tmp_path):
    import hashlib
    import io
    import tarfile
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.json", "1")
        f.writestr("b.json", "2")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert inventory.member_by_hash(z.getvalue(), sha(b"2")) == b"2"
    with pytest.raises(RuntimeError):
        inventory.member_by_hash(z.getvalue(), sha(b"3"))
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        info = tarfile.TarInfo("top/src/x.py")
        info.size = 1
        t.addfile(info, io.BytesIO(b"x"))
    assert inventory.archive_mismatches(tmp_path / "t.tar", {"src/x.py": sha(b"x")}) == []
    assert inventory.archive_mismatches(tmp_path / "t.tar", {"src/x.py": sha(b"y"), "z": "0"}) == ["src/x.py", "z"]


def test_corpus(spark):
    rows_ = spark.createDataFrame([({"ssa": {"d1": ("T", "body text here")}},)], "doc_data map<string, map<string, struct<title: string, doc_text: string>>>")
    assert [(r.document_id, r.text) for r in corpus.flatten(rows_).collect()] == [("ssa::d1", "body text here")]
    s = spark.createDataFrame([([("1", None, 5, 9)], "body text here"), ([("1", " x ", 0, 1)], "b")], "s array<struct<id: string, text: string, start: int, end: int>>, b string")
    assert [r.t for r in s.select(corpus.span_text(F.col("s"), F.lit("1"), F.col("b")).alias("t")).collect()] == ["text", "x"]
    with pytest.raises(Exception, match="resolve"):
        s.select(corpus.span_text(F.col("s"), F.lit("2"), F.col("b"))).collect()


def test_overlap_and_flow(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "a", "c", "x"]), (["a"], ["a"])], "x array<string>, y array<string>")
    got = df.select(*[c.alias(n) for n, c in diagnostics.overlap(F.col("x"), F.col("y")).items()]).collect()
    assert got[0].intersection_fraction == 0.75 and math.isclose(got[0].jaccard, 3 / 5) and not got[0].identical_set
    assert got[1].intersection_fraction == 0.25 and got[1].identical_order
    f = spark.createDataFrame([(["cat"], ["the cat x"], ["cat"], "no", [2, 0], [0]), ([], ["x"], ["x"], "x", [0], [0])], "s array<string>, p array<string>, t array<string>, k string, pg array<int>, sg array<int>")
    flow = f.select(*[c.alias(n) for n, c in diagnostics.evidence_flow(*[F.col(c) for c in ("s", "p", "t", "k", "pg", "sg")]).items()]).collect()
    assert flow[0].lost_in_packing == 1 and flow[0].grade2_recall == 0.0 and flow[1].grade2_recall is None


def test_best_match_without_references(spark):
    r = spark.createDataFrame([("", []), ("x", []), ("The x", ["y", "X!"])], "p string, r array<string>").select(T.best_f1("p", F.col("r")).alias("f"), T.best_exact_match("p", F.col("r")).alias("e")).collect()
    assert [(x.f, x.e) for x in r] == [(1.0, 1.0), (0.0, 0.0), (1.0, 1.0)]


def test_results_dont_hang_on_partitions(spark):
    chunks = spark.createDataFrame([(f"c{i:02d}", "d", f"w{i % 5} w{i % 3} x", i) for i in range(40)], "chunk_id string, doc_id string, text string, rank int")
    q = spark.createDataFrame([(1, "w1 x"), (2, "w2 w0")], "query_id int, text string")
    a = sorted(map(tuple, retrieval.bm25(q, chunks, 9).collect()))
    assert a == sorted(map(tuple, retrieval.bm25(q.repartition(3), chunks.repartition(7, "text"), 9).collect()))
    pool = chunks.withColumn("query_id", F.lit(1))
    assert retrieval.pool_hash(pool).first().pool_sha256 == retrieval.pool_hash(pool.orderBy(F.desc("chunk_id")).repartition(5)).first().pool_sha256
    assert retrieval.pool_hash(pool).first().pool_sha256 != retrieval.pool_hash(pool.withColumn("rank", F.col("rank") + 1)).first().pool_sha256


def test_pruning_reasons(spark):
    g = spark.createDataFrame([(1, ["a", "b"], 9, [5, 99]), (2, ["a"], 99, [5]), (3, ["a"], 5, [99])], "query_id int, negative_chunk_ids array<string>, p int, n array<int>")
    got = {r.query_id: (r.status, r.reason, r.kept_chunk_ids, r.pair_token_counts) for r in supervision.prune_pairs(g, F.col("p"), F.col("n"), 50).collect()}
    assert got == {1: ("retained", None, ["a"], [9, 5]), 2: ("excluded", "overlength_positive_pair", None, None), 3: ("excluded", "no_surviving_negative_pair", None, None)}
    with pytest.raises(Exception, match="limit"):
        supervision.collate(g, "query_id", F.col("negative_chunk_ids"), F.col("n"), 50).collect()
    with pytest.raises(ValueError):
        supervision.listwise_groups(rows(spark), 0)


def test_job_matrix(spark):
    j = supervision.job_matrix(spark, {"m": ["B", "E"], "r": [1, 2, 3]}).collect()
    assert len(j) == 6 and len({r.job_id for r in j}) == 6


def test_dialogue_one_per_group(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "g int, x string")
    one = dialogue.one_per(df, "g", F.col("x"), "s").collect()
    assert len(one) == 2 and dialogue.one_per(df.repartition(4), "g", F.col("x"), "s").where("g = 1").first().x == next(r.x for r in one if r.g == 1)


def test_schema_of_empty_inputs(spark):
    empty = spark.createDataFrame([], "query_id int, chunk_id string, rank int, grade int, doc_id string, text string, fused_rank int, chunker string")
    assert grading.ndcg(empty, ["query_id"]).count() == 0
    assert supervision.dedup_label_blind(empty).count() == supervision.listwise_groups(empty).count() == 0
    assert stats.summary(empty, "grade").first().n == 0
    chunks = spark.createDataFrame([], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "x")], "query_id int, text string")
    assert retrieval.bm25(q, chunks, 3).count() == 0
