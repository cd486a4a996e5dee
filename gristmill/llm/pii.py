"""Personal data by candidate gradient boosting, in DataFrame and SQL functions alone.

Fixed patterns give the base spans, which always stay.  Wider generators propose further, overlapping spans: unbracketed
and bracketed e-mail forms with letters of any script, eight-part addresses and four-part ones of any size, numbers of 12 to 19
digits in any grouping, numbers of 9 to 15 digits without a plus.  Each candidate has yes-or-no features of its format and of the
words around it, none of which repeats what the base patterns test for (the plus, the check digit, the top of 255).
A candidate counts as true where it overlaps a base span of its kind; the forms that no base pattern can meet (e-mails without
an @, eight-part addresses) are learned from FIXTURE, a few marked sentences, and from nothing else.
True and false candidates are counted by kind and feature set, over all documents: at most 4 x 2^10 rows.  From those
boosted trees of depth two are fitted for each kind, and scores are calibrated, on the same counts, by pooling
neighbours until the share of true candidates falls with the score.  Candidates of a share of PRECISION or more are added: those
that don't overlap a base span, and e-mails that hold one whole and more, such as a name with other letters before it.

Positions come from the texts between and in the matches: a match starts after the lengths of all before it.

Edge cases: a null or empty text has no spans; a kind without a true or a false candidate adds nothing; equal spans of
a kind are listed once; repeated rows count each; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialise, read

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Starts are anchored to the ends of what came before and repeats give nothing back, so that long texts take linear time.
LOCAL, LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE_LOCAL, WIDE_LABEL = r"[\p{L}\p{N}._%+-]", r"[\p{L}\p{N}-]"
WIDE = {
    "email": rf"(?<!{WIDE_LOCAL}){WIDE_LOCAL}++(?:@|\x20?[\[(]at[\])]\x20?){WIDE_LABEL}++(?:(?:\.|\x20?[\[(]dot[\])]\x20?){WIDE_LABEL}++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9]{1,5}\.){3}[0-9]{1,5}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20.-]?[0-9]){11,18}+(?![\x20.-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){8,14}+(?![\x20().-]{0,2}[0-9])",
}
GUARD = {"email": r"[@(\[]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
AROUND = 24
WORDS = {"email": "mail|contact|reach|write", "ip": "ip|addr|host|server", "card": "card|visa|master|amex|credit|pay", "phone": "tel|phone|call|fax|mobile|cell"}
PRECISION, ROUNDS, RATE = 0.95, 30, 0.3
#: Sentences of one candidate each: of the first of every pair of lists it is personal data, of the second it isn't.
FIXTURE = {
    "email": (
        ["write to anna [at] example [dot] com please", "contact: j.smith(at)mail.example.org", "mail me: bob [at] host.net, thanks", "reach sales [at] shop.example.com today", "contact maria.lopez [at] correo [dot] es", "mail info(at)firma.de or call", "write: k.novak(at)posta.cz soon", "reach us, desk [at] help.example.io now"],
        ["we met (at) noon.then we left", "sold (at) auction.house rules hold", "it is open (at) nine.five days", "priced [at] cost.plus two", "look (at) page.three of it", "they left (at) gate.b then", "he stood [at] ease.so did she", "held (at) dusk.no one came"],
    ),
    "ip": (
        ["host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is up", "addr fe80:0:0:0:202:b3ff:fe1e:8329", "server 2001:db8:0:1:1:1:1:1 answered", "the ip 2001:0db8:0:0:0:0:0:1 of it", "from host fd00:1:2:3:4:5:6:7", "addr: abcd:ef01:2345:6789:abcd:ef01:2345:6789", "ip 1:2:3:4:5:6:7:8 is up", "server 10:20:30:40:50:60:70:80 fell"],
        ["it rang 10:20:30:40:50:60:70:80 so", "a ratio 1:2:3:4:5:6:7:8 of parts", "steps 1:1:2:3:5:8:13:21 follow", "scores 3:2:4:1:0:2:3:1 so far", "bits dead:beef:dead:beef:dead:beef:dead:beef repeat", "a key ab12:cd34:ef56:ab78:cd90:ef12:ab34:cd56 here", "times 0:0:0:0:0:0:0:1 each", "sum 2001:1999:1998:1997:1996:1995:1994:1993 by year"],
    ),
}
FIXTURE_WEIGHT = 50
#: Candidates that no base pattern can meet: x.bits has the form's first bit unset, or set.
UNJUDGED = "(c.k = 0 and c.bits & 1 = 0) or (c.k = 1 and c.bits & 1 = 1)"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str, guard: str) -> str:
    """array<struct<s, e, m>>: the matches of `pattern` in text, in code points, the end exclusive."""
    p = _sql(pattern)
    found = f"""element_at(transform(array(struct(regexp_extract_all(text, {p}, 0) as m, split(text, {p}, -1) as g)), x ->
      aggregate(sequence(0, size(x.m)), struct(cast(array() as array<struct<s: int, e: int, m: string>>) as a, 0 as p),
        (acc, i) -> if(i = size(x.m), acc, struct(
          concat(acc.a, array(struct(acc.p + length(x.g[i]) as s, acc.p + length(x.g[i]) + length(x.m[i]) as e, x.m[i] as m))) as a,
          acc.p + length(x.g[i]) + length(x.m[i]) as p)),
        acc -> acc.a)), 1)"""
    return f"if(text rlike {_sql(guard)}, {found}, cast(array() as array<struct<s: int, e: int, m: string>>))"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    """The check-digit rule on the digits of m: from the right, every second digit is doubled, less 9 if it is over 9."""
    return f"""aggregate(transform(sequence(0, length({_digits(m)}) - 1), i -> if(i % 2 = 0, int(substring(reverse({_digits(m)}), i + 1, 1)),
      int(substring('0246813579', int(substring(reverse({_digits(m)}), i + 1, 1)) + 1, 1)))), 0, (a, d) -> a + d) % 10 = 0"""


VALID = {
    "email": "true",
    "ip": f"x.m rlike '^{OCTET}[.]{OCTET}[.]{OCTET}[.]{OCTET}$'",
    "card": f"length({_digits('x.m')}) between 12 and 19 and {_luhn('x.m')}",
    "phone": f"length({_digits('x.m')}) between 9 and 15",
}
#: By kind: what the format of a match x.m tells. Context follows: a word for the kind before it, a letter or digit right before or after, a sentence's space around it.
FORMAT = {
    "email": ["x.m rlike '@'", "x.m rlike '[0-9]'", "x.m rlike '[.](com|org|net|edu|gov|io)$'", "length(x.m) > 40", "x.m rlike '^[.]|[.]@'", "not x.m rlike '[^\\\\x21-\\\\x7E]'"],
    "ip": ["x.m rlike ':'", "not x.m rlike '(^|[.])0[0-9]'", "length(x.m) > 15", "x.m rlike '[0-9]{4,}'", "x.m rlike '^[1-9]'", "x.m rlike '^([0-9]{1,3}[.])+[0-9]{1,3}$'"],
    "card": ["x.m rlike '[.]'", "x.m rlike '^[0-9]+$'", "x.m rlike '^[0-9]{4}([ -])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}$'", f"length({_digits('x.m')}) = 16", "x.m rlike '^[3-6]'", f"length({_digits('x.m')}) in (13, 15)"],
    "phone": ["x.m rlike '[(][0-9]{3}[)]'", f"length({_digits('x.m')}) in (10, 11)", "x.m rlike '[0-9]{3}[ .-][0-9]{4}$'", "not x.m rlike '[^0-9+]'", "x.m rlike '[.]'", "x.m rlike '^[+]?1[ (]'"],
}


def _bits(kind: str) -> str:
    context = [
        f"lower(substring(text, greatest(x.s - {AROUND - 1}, 1), least({AROUND}, x.s))) rlike '{WORDS[kind]}'",
        "x.s > 0 and substring(text, x.s, 1) rlike '[A-Za-z0-9]'",
        "substring(text, x.e + 1, 1) rlike '[A-Za-z0-9]'",
        "(x.s = 0 or substring(text, x.s, 1) rlike '\\\\s') and (substring(text, x.e + 1, 1) = '' or substring(text, x.e + 1, 1) rlike '[\\\\s.,;]')",
    ]
    tests = [*FORMAT[kind], *context]
    return " + ".join(f"if({t}, {1 << i}, 0)" for i, t in enumerate(tests))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates): base array<struct<s, k, e>>, candidates array<struct<k, s, e, bits, hit, held>>: hit is an overlap
    with a base span of the kind, held one with any that the candidate may not add to."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _spans(d).select("doc_id", "base", "candidates")


def _spans(d: DataFrame) -> DataFrame:
    for k, kind in enumerate(KINDS):
        d = d.withColumn(f"base_{kind}", F.expr(f"transform(filter({_matches(BASE[kind], GUARD[kind])}, x -> {VALID[kind]}), x -> struct(x.s as s, {k} as k, x.e as e))"))
    d = d.withColumn("base", F.sort_array(F.concat(*[f"base_{k}" for k in KINDS])))
    for k, kind in enumerate(KINDS):
        d = d.withColumn(f"wide_{kind}", F.expr(f"transform({_matches(WIDE[kind], GUARD[kind])}, x -> struct({k} as k, x.s as s, x.e as e, {_bits(kind)} as bits, exists(base_{kind}, b -> b.s < x.e and x.s < b.e) as hit, exists(base, b -> b.s < x.e and x.s < b.e and not ({k} = 0 and b.k = 0 and x.s <= b.s and b.e <= x.e)) as held))"))
    return d.withColumn("candidates", F.concat(*[f"wide_{k}" for k in KINDS]))


def _counts(found: DataFrame) -> list[tuple[int, int, float, float]]:
    """(kind, feature set, candidates, true ones) of the documents and the fixture."""
    rows = found.select(F.explode("candidates").alias("c")).where(f"not ({UNJUDGED})")
    out = [(r.k, r.bits, float(r.n), float(r.y)) for r in rows.groupBy("c.k", "c.bits").agg(F.count("*").alias("n"), F.sum(F.col("c.hit").cast("long")).alias("y")).collect()]
    marked = [(k, y, text) for k, kind in enumerate(KINDS) for y, texts in zip((1, 0), FIXTURE.get(kind, ())) for text in texts]
    told = _spans(found.sparkSession.createDataFrame(marked, "kind int, y int, text string")).select("kind", "y", F.explode("candidates").alias("c")).where("c.k = kind")
    return out + [(r.kind, r.c.bits, float(FIXTURE_WEIGHT), float(FIXTURE_WEIGHT * r.y)) for r in told.collect()]


def _total(rows) -> list[tuple[int, float, float]]:
    sums: dict[int, list[float]] = {}
    for bits, n, y in rows:
        own = sums.setdefault(bits, [0.0, 0.0])
        own[0], own[1] = own[0] + n, own[1] + y
    return [(bits, n, y) for bits, (n, y) in sorted(sums.items())]


def fit(found: DataFrame) -> dict[int, tuple[list[tuple], float]]:
    """By kind: trees (bit, bit if it is set, bit if not, four leaves) and the threshold; kinds that can't be learned are left out."""
    rows = _counts(found)
    out = {}
    for k in range(len(KINDS)):
        data = _total((bits, n, y) for kind, bits, n, y in rows if kind == k)
        pos, n = sum(y for _, _, y in data), sum(n for _, n, _ in data)
        if not data or pos == 0 or pos == n:
            continue
        trees = _boost(data, pos, n)
        score = {bits: sum(_leaf(tree, bits) for tree in trees) for bits, _, _ in data}
        blocks: list[list[float]] = []  # score, candidates, true ones; pooled so that the share of true ones falls with the score
        for bits, m, y in sorted(data, key=lambda d: (-score[d[0]], d[0])):
            blocks.append([score[bits], m, y])
            while len(blocks) > 1 and blocks[-1][2] * blocks[-2][1] >= blocks[-2][2] * blocks[-1][1]:
                low = blocks.pop()
                blocks[-1] = [low[0], blocks[-1][1] + low[1], blocks[-1][2] + low[2]]
        sure = [low for low, m, y in blocks if y >= PRECISION * m]
        if sure:
            out[k] = (trees, min(sure) - 1e-9)
    return out


def _boost(data: list[tuple[int, float, float]], pos: float, n: float) -> list[tuple]:
    start = math.log(pos / (n - pos))
    score = {bits: start for bits, _, _ in data}
    trees: list[tuple] = [(-1, -1, -1, start, 0.0, 0.0, 0.0)]
    for _ in range(ROUNDS):
        grad = {}
        for bits, m, y in data:
            p = 1 / (1 + math.exp(-score[bits]))
            grad[bits] = (y - m * p, m * p * (1 - p))
        tree = _tree(grad)
        trees.append(tree)
        for bits in score:
            score[bits] += _leaf(tree, bits)
    return trees


def _gain(g: float, h: float) -> float:
    return g * g / (h + 1)


def _split(grad: dict[int, tuple[float, float]]) -> tuple[float, int]:
    best = (-1.0, 0)
    for bit in range(10):
        on = [v for b, v in grad.items() if b >> bit & 1]
        off = [v for b, v in grad.items() if not b >> bit & 1]
        best = max(best, (_gain(sum(g for g, _ in on), sum(h for _, h in on)) + _gain(sum(g for g, _ in off), sum(h for _, h in off)), -bit))
    return best[0], -best[1]


def _tree(grad: dict[int, tuple[float, float]]) -> tuple:
    root = _split(grad)[1]
    sides, leaves = [], []
    for want in (1, 0):
        part = {b: v for b, v in grad.items() if b >> root & 1 == want}
        bit = _split(part)[1]
        sides.append(bit)
        for inner in (1, 0):
            own = [v for b, v in part.items() if b >> bit & 1 == inner]
            leaves.append(RATE * sum(g for g, _ in own) / (sum(h for _, h in own) + 1))
    return (root, *sides, *leaves)


def _leaf(tree: tuple, bits: int) -> float:
    root, on, off, *leaves = tree
    if root < 0:
        return leaves[0]
    first = 0 if bits >> root & 1 else 1
    bit = (on, off)[first]
    return leaves[2 * first + (0 if bits >> bit & 1 else 1)]


def _score(trees: list[tuple]) -> str:
    """The trees as SQL over x.bits."""
    parts = []
    for root, on, off, *leaves in trees:
        if root < 0:
            parts.append(f"{leaves[0]!r}D")
        else:
            side = lambda bit, a, b: f"if(getbit(x.bits, {bit}) = 1, {a!r}D, {b!r}D)"
            parts.append(f"if(getbit(x.bits, {root}) = 1, {side(on, *leaves[:2])}, {side(off, *leaves[2:])})")
    return " + ".join(parts)


def _added(model: dict[int, tuple[list[tuple], float]]) -> Column:
    """The candidates that the trees select, as array<struct<s, k, e>>; overlapping ones of a kind keep the first."""
    chosen = " or ".join(f"(x.k = {k} and not x.held and {_score(trees)} >= {least!r}D)" for k, (trees, least) in model.items()) or "false"
    return F.expr(f"transform(filter(candidates, x -> {chosen}), x -> struct(x.s as s, x.k as k, x.e as e))")


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")


def find(docs: DataFrame) -> DataFrame:
    """A row for each document: base spans by kind and joined, and all spans; one pass over the texts."""
    found = materialise(spans(docs), "pii")
    out = found.withColumn("all", F.sort_array(F.array_distinct(F.concat("base", _added(fit(found))))))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"), F.expr("cast(size(all) - size(base) as long)").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs`, with all columns, each span of the text replaced by its kind in brackets; overlapping spans by the first's.

    The rows are written with their spans, so that texts are searched once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"))
    found = materialise(_spans(own).select("row", "base", "candidates"), "pii")
    own = found.withColumns({"text": F.coalesce(F.col("row.text").cast("string"), F.lit("")), "all": F.sort_array(F.array_distinct(F.concat("base", _added(fit(found)))))})
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    clean = F.expr(f"""if(size(all) = 0, row.text, aggregate(all, struct('' as t, 0 as p),
      (a, x) -> if(x.e <= a.p, a, struct(concat(a.t, substring(text, a.p + 1, greatest(x.s - a.p, 0)), if(x.s >= a.p, element_at(array({names}), x.k + 1), '')) as t, x.e as p)),
      a -> concat(a.t, substring(text, a.p + 1))))""")
    return own.select("row", clean.alias("clean")).select(*[F.col("clean").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir):
    return find(read(spark, sf_dir, "documents"))
