"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct k-word shingles, hashed to 64 bits.  Two sets link when 100 x intersection is at least
`percent` x union.  The answer is the connected components of the links, by these steps:

1. Equal sets are one class, named by its smallest id; only classes are joined.
2. Each class has a sketch: the parity of its shingles in each of SKETCH cells. Sketches of two sets differ in no more cells
   than the sets in shingles, which bounds the overlap; pairs below what is asked for are dropped before any text is read.
   Index: sets that link share a shingle among the first n - ceil(percent n / 100) + 1 of each, in any one order of the
   shingles; here frequent ones come last, then by hash.  Each class lists its prefix in the index with its size and the
   shingle's position.  Lists are skipped by block: a pair is passed over where sizes are too far apart, or where what
   follows the positions of the shared shingle is too short for the overlap asked for.
3. Each list proposes its smallest set as leader to all others; the pairs are verified on the texts.  Linked sets are
   then in one component.  This is done again with other leaders in long lists that still hold several components, ROUNDS times
   in all.  Each set keeps its smallest verified leader as pivot with the overlap.
4. What is left are lists that hold sets of different components.  Their sets are blocks by pivot.  An overlap of x and y
   is at most |p & q| + |x - p| + |y - q| for pivots p and q: with the bound of the sketches, which the blocks carry, whole
   blocks are skipped as lists are read, before a row is written; then the pivots are verified and, from that computed answer,
   the pairs of members below what is asked for are skipped too.  Lists of more than MEMBERS blocks are dealt to several tasks.
   Pivots that don't link, but share a frequent shingle of their prefixes and that sizes, positions and sketches can't tell
   apart, are compared pair by pair: this part grows with the square of such pivots.
   Pairs inside a component are not needed for this: no link between components is lost.
5. Components of all verified links.
6. Links inside components are counted for each class: what the pivots' overlaps settle is counted by groups of members, so that
   no group gives all its pairs; the pairs that stay open are verified on the texts (`join_links`).

The order of shingles is free, so the frequent ones need not be found exactly: shingles are counted where they occur twice or
more in a run of CHUNK shingles, and the most frequent HOT_MOST of those counted HOT or more are moved last and sent to all
executors.  Their lists are dealt out by set as well, so that no task gets a whole one.

Edge cases: null and empty texts and those without words have an empty set and are linked with nothing (component: the id
itself); a text of fewer than k words is one shingle; a null id takes part only through the documents with an equal set
and has a null component where those have none either; equal rows get equal rows; an id that stands for different texts has a
row for each, and they link only if the texts do; an empty table gives an empty result;
further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.llm.common import as_bytes, documents, map_arrow, materialise, read, schema_of, tidy
from gristmill.llm.hashing import shingle_sets

WORDS, PERCENT = 3, 90
CHUNK, HOT, HOT_MOST, SALTS = 1_000_000, 4, 1 << 20, 64
SKETCH, FOLD = 1024, 256
ROUNDS, LEADERS, LONG = 3, 12, 32
MEMBERS, TILE = 500, 250_000
BROADCAST_ROWS = 1_000_000


def _digest(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return h >> 64, h & (1 << 64) - 1


def _sketch(s: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).view(np.int64)


def _signed(values, count: int = -1) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _survey(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents (kind 0: doc_id, n, digest a and b, sketch) and of shingles met twice or more in a chunk (kind 1: n times a)."""
    names = ["kind", "doc_id", "n", "a", "b", "sketch"]

    def run(batches):
        held, size, seen = [], 0, set()

        def repeated():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            values, n = values[n > 1], n[n > 1]
            nothing = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int8)), nothing, pa.array(n.astype(np.int64)), _signed(values), nothing, pa.nulls(len(n), pa.list_(pa.int64()))], names=names)

        for batch in batches:
            n, a, b, sketches = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), k):
                x, y = _digest(s)
                sketches.append(_sketch(s))
                n.append(len(s))
                a.append(x)
                b.append(y)
                if len(s) and x not in seen:
                    seen.add(x)
                    held.append(s)
                    size += len(s)
                if size >= CHUNK:
                    yield repeated()
                    held, size, seen = [], 0, set()
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(np.concatenate([np.empty(0, np.int64), *sketches])))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int8)), batch.column(0), pa.array(n, pa.int64()), _signed(a), _signed(b), cells], names=names)
        if held:
            yield repeated()

    return map_arrow(as_bytes(docs), run, schema_of("kind tinyint, doc_id long, n long, a long, b long, sketch array<long>"))


def _frequent(survey: DataFrame) -> np.ndarray:
    """The hashes of at most HOT_MOST frequent shingles, sorted."""
    counted = survey.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).withColumn("bin", F.floor(F.log2("n") * 4).cast("int"))
    left, least = HOT_MOST, None
    for r in sorted(counted.groupBy("bin").count().collect(), key=lambda r: -r.bin):
        left -= r["count"]
        if left < 0:
            break
        least = r.bin
    if least is None:
        return np.empty(0, np.uint64)
    return np.sort(counted.where(F.col("bin") >= least).select("a").toArrow().column("a").to_numpy().view(np.uint64))


def _postings(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(token, sid, place) of the prefixes; place packs salt, size and position: salt << 56 | n << 24 | position."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        hot, seen = sent.value, set()
        for batch in batches:
            tokens, sids, places = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), k):
                if not len(s):
                    continue
                sid = _digest(s)[0]
                if sid in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(sid)
                n = len(s)
                take = n - -(-percent * n // 100) + 1
                is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(n, bool)
                rare = s[~is_hot][:take]
                prefix = np.concatenate((rare, s[is_hot][: take - len(rare)]))
                salt = np.zeros(len(prefix), np.int64)
                salt[len(rare) :] = 1 + sid % SALTS
                tokens.append(prefix)
                sids.append(np.full(len(prefix), sid, np.uint64))
                places.append(salt << 56 | n << 24 | np.arange(len(prefix)))
            if tokens:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(tokens)), _signed(np.concatenate(sids)), pa.array(np.concatenate(places))], names=["token", "sid", "place"])

    return map_arrow(as_bytes(docs), run, schema_of("token long, sid long, place long"))


def _shared(postings: DataFrame) -> DataFrame:
    """Lists with more than one set: (token, sid, n, pos). Rows come sorted by token and set; frequent tokens always stay."""
    dealt = postings.repartition("token", F.shiftright("place", 56)).sortWithinPartitions("token", "sid")

    def run(batches):
        last = None  # the open list, of which no second set has come yet: (token, sid, place)
        told = None  # the token whose list is known to be shared
        for batch in batches:
            t, s, p = (batch.column(i).to_numpy() for i in range(3))
            if last is not None:
                t, s, p = (np.concatenate(([x], y)) for x, y in zip(last, (t, s, p)))
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
            t, s, p = t[new], s[new], p[new]
            same = np.zeros(len(t) + 1, bool)
            same[1:-1] = t[1:] == t[:-1]
            keep = same[1:] | same[:-1] | (p >> 56 > 0)
            if told is not None:
                keep |= t == told
            last = (t[-1], s[-1], p[-1])
            ended = keep.copy()
            ended[-1] = False  # the last row stays open: it comes again with the next batch
            told = t[-1] if keep[-1] else None
            yield pa.RecordBatch.from_arrays([pa.array(t[ended]), pa.array(s[ended]), pa.array(p[ended])], names=["token", "sid", "place"])
        if last is not None and (told is not None or last[2] >> 56 > 0):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in last], names=["token", "sid", "place"])

    kept = map_arrow(dealt, run, schema_of("token long, sid long, place long"))
    return kept.select("token", "sid", F.shiftright("place", 24).bitwiseAND(F.lit((1 << 32) - 1)).alias("n"), F.col("place").bitwiseAND(F.lit((1 << 24) - 1)).alias("pos"))


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int, beyond: str = "0", sizes: str = "x_n + y_n") -> DataFrame:
    """Of pairs (x, y) those whose sketches leave room for the overlap asked for.

    For blocks: x and y are pivots, `beyond` is the most that a pair of their members can have in common beside what the pivots
    have, `sizes` the smallest sum of sizes of such a pair.
    """
    pairs = materialise(pairs, "proposed")
    sketches = _only(sketches, pairs.select(F.explode(F.array("x", "y")).alias("id")))
    x, y = (sketches.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch")) for side in "xy")
    apart = " + ".join(f"bit_count(x_sketch[{i}] ^ y_sketch[{i}])" for i in range(SKETCH // 64))
    return pairs.join(x, "x").join(y, "y").where(f"(x_n + y_n - ({apart}) + 2 * ({beyond})) * {100 + percent} >= {2 * percent} * ({sizes})").select(*pairs.columns)


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows that have one of the keys, looked up where they are read while the keys are BROADCAST_ROWS at most."""
    keys = materialise(keys.distinct(), "keys")
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, keys.columns, "left_semi")


def _possible(percent: int) -> str:
    """Whether sets of x_n and y_n that share a first shingle at x_pos and y_pos can link."""
    return f"100 * x_n >= {percent} * y_n and 100 * y_n >= {percent} * x_n and (1 + least(x_n - x_pos, y_n - y_pos) - 1) * {100 + percent} >= {percent} * (x_n + y_n)"


def verify(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(x, y, x_n, y_n, overlap) of pairs of ids (x, y), from the texts.

    Pairs of an x are dealt out in runs of about MEMBERS; each run gets the text of x first, then those of the ys one by
    one, so that a task holds one set and a text at a time.
    """
    runs = pairs.groupBy("x").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("runs"))
    dealt = pairs.join(runs, "x").withColumn("run", F.pmod(F.xxhash64("y"), F.col("runs")).cast("int"))
    heads = runs.select("x", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run")).select("x", "run", F.lit(0).alias("role"), F.col("x").alias("doc_id"))
    asked = materialise(dealt.select("x", "run", F.lit(1).alias("role"), F.col("y").alias("doc_id")).unionByName(heads), "asked")
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    texts = as_bytes(docs).join(asked, "doc_id").select("x", "run", "role", "doc_id", "text")

    def run(batches):
        own = None
        for b in batches:
            out = []
            for x, role, y, s in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), shingle_sets(b.column(4).to_pylist(), k)):
                if role == 0:
                    own = s
                    continue
                out.append((x, y, len(own), len(s), len(np.intersect1d(own, s, assume_unique=True))))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["x", "y", "x_n", "y_n", "overlap"])

    return map_arrow(texts.repartition("x", "run").sortWithinPartitions("x", "run", "role", "doc_id"), run, schema_of("x long, y long, x_n long, y_n long, overlap long"))


def _links(percent: int):
    return F.expr(f"100 * overlap >= {percent} * (x_n + y_n - overlap)")


def components(edges: DataFrame, steps: int | None = None) -> DataFrame:
    """(id, label): the smallest id reachable from each id of edges (x, y).

    With `steps`, labels after so many: reachable ids, but not yet the smallest in a long chain.
    """
    both = materialise(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = materialise(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("id"), F.least("x", "y").alias("label")), "labels")
    while steps is None or steps > 0:
        around = both.join(labels.select(F.col("id").alias("y"), "label"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        step = materialise(lower.join(up, "label").select("id", "old", F.least("label", "up").alias("label")), "labels")
        labels = step.select("id", "label")
        if steps is not None:
            steps -= 1
        elif step.where("label < old").isEmpty():
            break
    return labels


def _mixed(placed: DataFrame, least: int = 2) -> DataFrame:
    """The lists, of `least` sets or more, that hold sets of different components."""
    tokens = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("sets"))
    return placed.join(tokens.where((F.col("low") < F.col("high")) & (F.col("sets") >= least)).select("token"), "token")


def _by_leaders(docs: DataFrame, lists: DataFrame, sketches: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs verified with the leaders of ROUNDS rounds, and the components (id, label) of their links.

    A round proposes leaders in each list to all sets of other components: first the smallest set, then, in lists of LONG sets
    or more, the LEADERS sets that have the largest share of themselves in such lists and haven't led yet. The most ordinary members
    of a group of near copies are similar to the most others. The pairs grow with the lists, not with their square.
    """
    verified = within = None
    for number in range(ROUNDS):
        if number:
            placed = _mixed(lists.join(within, "id", "left").withColumn("label", F.coalesce("label", "id")), LONG)
            placed = materialise(placed, "long")
            lists = placed.drop("label")
            used = verified.select(F.col("x").alias("id")).distinct()
            central = placed.groupBy("id").agg((F.count("*") / F.max("n")).alias("share")).join(used, "id", "left_anti")
            order = W.partitionBy("token").orderBy(F.desc(F.round("share", 2)), F.xxhash64("id", F.lit(number)), "id")
            leaders = placed.join(central, "id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEADERS)
            leaders = leaders.select("token", F.struct("id", "n", "pos", "label").alias("y"))
        else:
            placed = lists.withColumn("label", F.col("id"))
            leaders = placed.groupBy("token").agg(F.min(F.struct("n", "id", "pos", "label")).alias("y"))
        proposed = placed.join(leaders, "token").where("label <> y.label").select(F.col("id"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"), F.col("y.id").alias("lead"), F.col("y.n").alias("y_n"), F.col("y.pos").alias("y_pos"))
        pairs = proposed.where(_possible(percent)).select(F.col("lead").alias("x"), F.col("id").alias("y")).distinct()
        if verified is not None:
            pairs = pairs.join(_either_way(verified).select("x", "y"), ["x", "y"], "left_anti")
        found = materialise(verify(docs, _alike(pairs, sketches, percent), k), "verified")
        verified = found if verified is None else verified.unionByName(found)
        within = components(verified.where(_links(percent)).select("x", "y"), None if number == ROUNDS - 1 else 1)
        tidy(docs.sparkSession)
    return verified, within


def _either_way(verified: DataFrame) -> DataFrame:
    return verified.select("x", "y", "x_n", "y_n", "overlap").unionByName(verified.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("y_n").alias("x_n"), F.col("x_n").alias("y_n"), "overlap"))


def _joined(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, ...]:
    """Sets by document, classes, components (id, label), verified pairs and the sketches of classes."""
    survey = materialise(_survey(docs, k), "survey")
    sets = survey.where("kind = 0").select("doc_id", "n", "a", "b")
    classes = materialise(sets.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    names = classes.where("rep is not null").select(F.col("a").alias("sid"), F.col("rep").alias("id"))
    sketches = materialise(survey.where("kind = 0").select(F.col("doc_id").alias("id"), "n", "sketch").join(names.select("id"), "id").dropDuplicates(["id"]), "sketches")
    lists = materialise(_shared(_postings(docs, k, percent, _frequent(survey))).join(names, "sid").select("token", "id", "n", "pos"), "lists")

    verified, within = _by_leaders(docs, lists, sketches, k, percent)
    links = verified.where(_links(percent)).select("x", "y")
    pivots = verified.where(_links(percent)).groupBy(F.col("y").alias("id")).agg(F.min(F.struct(F.col("x").alias("pivot"), (F.col("y_n") - F.col("overlap")).alias("beyond"))).alias("p"))
    placed = _mixed(lists.join(within, "id", "left").withColumn("label", F.coalesce("label", "id"))).join(pivots, "id", "left")
    left = materialise(placed.select("token", "id", "n", "pos", "label", F.coalesce("p.pivot", "id").alias("pivot"), F.coalesce("p.beyond", F.lit(0)).alias("beyond")), "left")
    if not left.isEmpty():
        more = _across(docs, left, verified, sketches, k, percent)
        links = links.unionByName(more)
        within = components(links)
        tidy(docs.sparkSession)
    return sets, classes, within, verified, sketches


def _output(sets: DataFrame, classes: DataFrame, within: DataFrame) -> DataFrame:
    out = sets.join(classes, ["a", "b"], "left").join(within.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "rep")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def _clashes(docs: DataFrame) -> bool:
    """Whether an id stands for different texts."""
    ids = documents(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    return not ids.where("low < high").isEmpty()


def _by_content(docs: DataFrame, join, k: int, percent: int) -> DataFrame:
    """The answer of `join` where ids stand for different texts: rows go by a key of id and text, and their components and
    classes are named by the smallest id in them again."""
    keyed = documents(docs).select(F.col("doc_id").alias("own"), _key("doc_id", "text").alias("doc_id"), "text")
    out = materialise(join(keyed.select("doc_id", "text"), k, percent).join(keyed.select("doc_id", "own").distinct(), "doc_id"), "by-content")
    named = {c: out.groupBy(c).agg(F.min("own").alias(f"{c}_named")) for c in ("component_id", "class_id")}
    back = out
    for c, names in named.items():
        back = back.join(names, c)
    return back.select(F.col("own").alias("doc_id"), *[F.col(f"{c}_named").alias(c) if c in named else F.col(c) for c in out.columns if c not in ("doc_id", "own")], F.col("doc_id").alias("key"))


def _key(doc_id, text):
    return F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit("")))


def join_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document: its set's size, its class and its component."""
    return _by_content(docs, _components, k, percent).drop("key") if _clashes(docs) else _components(docs, k, percent)


def join_links(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`join_components` with n_links, the number of other documents that a document links with, equal ones and all others."""
    return _by_content(docs, _links_too, k, percent).drop("key") if _clashes(docs) else _links_too(docs, k, percent)


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    return _output(*_joined(docs, k, percent)[:3]).drop("copies")


def _links_too(docs: DataFrame, k: int, percent: int) -> DataFrame:
    sets, classes, within, verified, sketches = _joined(docs, k, percent)
    out = materialise(_output(sets, classes, within), "joined")
    sizes = out.where("n_shingles > 0 and class_id is not null").groupBy(F.col("class_id").alias("id")).agg(F.max("n_shingles").alias("n"), F.max("copies").alias("copies"))
    near = _near(docs, within, materialise(sizes, "sizes"), verified, sketches, k, percent)
    both = out.join(near.withColumnRenamed("id", "class_id"), "class_id", "left")
    n_links = F.when(F.col("n_shingles") > 0, F.coalesce("near", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    return both.select(*out.drop("copies").columns, n_links.cast("long").alias("n_links"))


def _near(docs: DataFrame, within: DataFrame, sizes: DataFrame, verified: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, near): of each class in a component, the documents of the other classes that it links with.

    x of pivot p and y of pivot q have |p & q| - |p - x| - |q - y| in common at least, and |p & q| + |x - p| + |y - q| at most.
    Members of a pivot are put together by size and distance to it, so that pairs of such cells that all link, or can't, are
    answered by the pivots' overlap without any pair of members; members of the cells that stay open are verified on the texts.
    """
    asks = f"* {100 + percent} >= {percent} *"
    pivot = F.struct(F.col("x").alias("pivot"), (F.col("y_n") - F.col("overlap")).alias("beyond"), (F.col("x_n") - F.col("overlap")).alias("lost"))
    pivots = verified.where(_links(percent)).groupBy(F.col("y").alias("id")).agg(F.min(pivot).alias("p"))
    cell = ["pivot", "n", "beyond", "lost"]
    members = within.join(sizes, "id").join(pivots, "id", "left")
    members = materialise(members.select("label", "id", "n", "copies", F.coalesce("p.pivot", "id").alias("pivot"), F.coalesce("p.beyond", F.lit(0)).alias("beyond"), F.coalesce("p.lost", F.lit(0)).alias("lost")), "members")
    cells = materialise(members.groupBy("label", *cell).agg(F.sum("copies").alias("w")), "cells")

    blocks = cells.groupBy("label", "pivot").agg(F.max("beyond").alias("beyond"), F.min("n").alias("least"), F.max("n").alias("most"))
    asked = materialise(_pivots_alike(blocks, sketches, percent), "asked-pivots")
    known = _either_way(verified).select("x", "y", "overlap").distinct()
    shingles = sizes.select("id", "n")
    new = _verify_together(docs, asked.join(known, ["x", "y"], "left_anti"), shingles, k).select("x", "y", "overlap")
    answers = materialise(asked.join(known, ["x", "y"]).select("x", "y", "overlap").unionByName(new), "pivots")
    own = cells.select(F.col("pivot").alias("x"), F.col("pivot").alias("y"), (F.col("n") - F.col("beyond") + F.col("lost")).alias("overlap")).distinct()
    answers = answers.unionByName(answers.select(F.col("y").alias("x"), F.col("x").alias("y"), "overlap")).unionByName(own)

    # sure is a bound on a sum, a number of x and one of y: a pivot's members are counted by theirs, in at most twice as many
    # steps as the pivot has shingles, and each number of x is looked up in the steps of every pivot around
    need = F.expr(f"{100 + percent} * lost + {percent} * n").alias("need")
    steps = cells.groupBy("pivot", need).agg(F.sum("w").alias("w"))
    profiles = steps.groupBy(F.col("pivot").alias("y")).agg(F.collect_list(F.struct("need", "w")).alias("profile"))
    looked = steps.select(F.col("pivot").alias("x"), "need").join(answers, "x").join(profiles, "y").withColumn("room", F.expr(f"overlap * {100 + percent} - need"))
    held = F.expr("aggregate(profile, 0L, (w, p) -> w + if(p.need <= room, p.w, 0L))")
    sure = looked.groupBy(F.col("x").alias("pivot"), "need").agg(F.sum(held).alias("w"), F.max(F.expr("x = y and need <= room")).alias("self"))
    counted = members.withColumn("need", need).join(sure, ["pivot", "need"]).select("id", (F.col("w") - F.when(F.col("self"), F.col("copies")).otherwise(0)).alias("near"))

    a, b = (cells.select(*[F.col(c).alias(f"{side}_{c}") for c in cell]) for side in "ab")
    grid = a.join(answers, a["a_pivot"] == answers["x"]).join(b, answers["y"] == b["b_pivot"])
    grid = grid.where(f"least(overlap + a_beyond + b_beyond, a_n, b_n) {asks} (a_n + b_n) and not (overlap - a_lost - b_lost) {asks} (a_n + b_n)")
    grid = materialise(grid.where("x <= y").drop("x", "y"), "grid")
    pairs = _members_alike(members, grid, sketches, percent)
    found = materialise(_verify_together(docs, pairs, shingles, k).where(_links(percent)), "inner").select("x", "y")
    found = found.unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y")))
    found = found.join(sizes.select(F.col("id").alias("y"), "copies"), "y").select(F.col("x").alias("id"), F.col("copies").alias("near"))
    return counted.unionByName(found).groupBy("id").agg(F.sum("near").alias("near"))


def _pivots_alike(blocks: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(label, x, y), x < y, of the pivots of a component whose sketches leave room for links of their members.

    The pivots of a component are dealt to tiles of about MEMBERS, and each pair of tiles is compared in one go.
    """
    many = blocks.groupBy("label").count().where("count > 1").select("label", F.ceil(F.col("count") / MEMBERS).cast("int").alias("tiles"))
    own = materialise(blocks.join(many, "label").withColumn("tile", F.pmod(F.xxhash64("pivot"), F.col("tiles")).cast("int")), "tiles")
    own = own.join(_only(sketches, own.select(F.col("pivot").alias("id"))).select(F.col("id").alias("pivot"), F.col("n").alias("size"), "sketch"), "pivot")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    spread = own.select("*", other).select("label", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), F.struct("pivot", "tile", "least", "most", "size", "beyond", "sketch").alias("of"))
    grouped = spread.groupBy("label", "i", "j").agg(F.collect_list("of").alias("of"))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                label, i, j = (batch.column(c)[r].as_py() for c in range(3))
                of = batch.column(3)[r].values
                pivot, tile, least, most, size, beyond = (of.field(c).to_numpy() for c in range(6))
                sketch = of.field(6).flatten().to_numpy().reshape(len(pivot), -1).view(np.uint64)
                xs, ys = [], []
                for a in np.flatnonzero(tile == i):
                    b = np.flatnonzero((tile == j) & ((pivot > pivot[a]) | (i != j)))
                    b = b[(100 * most[a] >= percent * least[b]) & (100 * most[b] >= percent * least[a])]
                    apart = np.bitwise_count(sketch[b] ^ sketch[a]).sum(1, dtype=np.int64)
                    b = b[(size[a] + size[b] - apart + 2 * (beyond[a] + beyond[b])) * (100 + percent) >= 2 * percent * (least[a] + least[b])]
                    xs.append(np.minimum(pivot[b], pivot[a]))
                    ys.append(np.maximum(pivot[b], pivot[a]))
                xs, ys = (np.concatenate([np.empty(0, np.int64), *c]) for c in (xs, ys))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(xs), label)), pa.array(xs), pa.array(ys)], names=["label", "x", "y"])

    return map_arrow(grouped, run, schema_of("label long, x long, y long"))


def _members_alike(members: DataFrame, grid: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(label, x, y), x < y, of the members of open cells that the pivots' overlap doesn't settle and whose sketches leave room.

    A pivot's members in open cells are packed by MEMBERS; packs of pivots with open cells meet, and only pairs that stay are told.
    """
    cell = ["pivot", "n", "beyond", "lost"]
    cells = grid.select(*[F.col(f"a_{c}").alias(c) for c in cell]).union(grid.select(*[F.col(f"b_{c}").alias(c) for c in cell])).distinct()
    opened = materialise(members.join(cells, cell, "left_semi").select("label", "id", *cell), "opened")
    packs = opened.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("packs"))
    dealt = opened.join(packs, "pivot").withColumn("pack", F.pmod(F.xxhash64("id"), F.col("packs")).cast("int"))
    dealt = dealt.join(_only(sketches, opened.select("id")).select("id", "sketch"), "id")
    packed = materialise(dealt.groupBy("label", "pivot", "pack").agg(F.collect_list(F.struct("id", "n", "beyond", "lost", "sketch")).alias("of")), "packs")
    a, b = (packed.select("label", *[F.col(c).alias(f"{side}_{c}") for c in ("pivot", "pack", "of")]) for side in "ab")
    met = grid.select("a_pivot", "b_pivot", "overlap").distinct().join(a, "a_pivot").join(b.drop("label"), "b_pivot")
    met = met.where("a_pivot < b_pivot or a_pack <= b_pack").select("label", "overlap", ((F.col("a_pivot") == F.col("b_pivot")) & (F.col("a_pack") == F.col("b_pack"))).alias("same"), "a_of", "b_of")

    def unpack(of):
        return [of.field(c).to_numpy() for c in range(4)] + [of.field(4).flatten().to_numpy().reshape(len(of), -1).view(np.uint64)]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                label, overlap, same = (batch.column(c)[r].as_py() for c in range(3))
                x, x_n, x_beyond, x_lost, x_sketch = unpack(batch.column(3)[r].values)
                y, y_n, y_beyond, y_lost, y_sketch = unpack(batch.column(4)[r].values)
                xs, ys = [], []
                for i in range(len(x)):
                    need = percent * (x_n[i] + y_n)
                    most = np.minimum(np.minimum(overlap + x_beyond[i] + y_beyond, x_n[i]), y_n)
                    still = (most * (100 + percent) >= need) & ((overlap - x_lost[i] - y_lost) * (100 + percent) < need)
                    j = np.flatnonzero(still & (y > x[i]) if same else still)
                    apart = np.bitwise_count(y_sketch[j] ^ x_sketch[i]).sum(1, dtype=np.int64)
                    j = j[(x_n[i] + y_n[j] - apart) * (100 + percent) >= 2 * need[j]]
                    xs.append(np.minimum(y[j], x[i]))
                    ys.append(np.maximum(y[j], x[i]))
                xs, ys = (np.concatenate([np.empty(0, np.int64), *c]) for c in (xs, ys))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(xs), label)), pa.array(xs), pa.array(ys)], names=["label", "x", "y"])

    return map_arrow(met, run, schema_of("label long, x long, y long"))


def _verify_together(docs: DataFrame, pairs: DataFrame, shingles: DataFrame, k: int) -> DataFrame:
    """`verify` for pairs (label, x, y) inside components: a component's ids are dealt to tiles of about TILE shingles, and a
    text is sent once for each pair of tiles that asks for it, however many pairs it is in. A task holds the sets of two tiles.
    """
    pairs = materialise(pairs, "together")
    ids = pairs.select("label", F.explode(F.array("x", "y")).alias("id")).distinct().join(shingles, "id")
    tiles = ids.groupBy("label").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"))
    cells = pairs.join(tiles, "label").select("label", *[F.pmod(F.xxhash64(c), F.col("tiles")).cast("int").alias(t) for c, t in (("x", "i"), ("y", "j"))], "x", "y")
    asked = materialise(cells.select("label", "i", "j", F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "asked")
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    texts = as_bytes(docs).join(asked, "doc_id").select("label", "i", "j", F.col("doc_id").alias("x"), F.lit(None).cast("long").alias("y"), "text")
    rows = texts.unionByName(cells.withColumn("text", F.lit(None).cast("binary")))

    def run(batches):
        cell, sets = None, {}
        for b in batches:
            out = []
            texts = [t if t is not None else b"" for t in b.column(5).to_pylist()]
            for label, i, j, x, y, s in zip(*(b.column(c).to_pylist() for c in range(5)), shingle_sets(texts, k)):
                if cell != (label, i, j):
                    cell, sets = (label, i, j), {}
                if y is None:
                    sets[x] = s
                else:
                    p, q = sets[x], sets[y]
                    out.append((x, y, len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["x", "y", "x_n", "y_n", "overlap"])

    return map_arrow(rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", F.asc_nulls_first("y"), "x"), run, schema_of("x long, y long, x_n long, y_n long, overlap long"))


def _across(docs: DataFrame, left: DataFrame, verified: DataFrame, sketches: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links (x, y) between different components, from the lists that hold more than one."""
    blocks = left.groupBy("token", "pivot", "label").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("pos"), F.max("beyond").alias("beyond"), ((F.min("id") == F.col("pivot")) & (F.max("id") == F.col("pivot"))).alias("alone"))
    # sketches are folded for the lists, cells that are FOLD apart put together: differences of folded ones are differences of whole ones
    folded = [F.expr(" ^ ".join(f"sketch[{i}]" for i in range(word, SKETCH // 64, FOLD // 64))).alias(f"s{word}") for word in range(FOLD // 64)]
    blocks = materialise(blocks.join(sketches.select(F.col("id").alias("pivot"), F.col("n").alias("size"), *folded), "pivot"), "pivot-blocks")
    parts = materialise(blocks.groupBy("token").count().where(F.col("count") > MEMBERS).select("token", F.ceil(F.col("count") / MEMBERS).cast("int").alias("parts")), "long-lists")
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    columns = ("pivot", "label", "least", "most", "pos", "beyond", "alone", "size", *[f"s{word}" for word in range(FOLD // 64)])
    apart = " + ".join(f"bit_count(a.s{word} ^ b.s{word})" for word in range(FOLD // 64))
    meet = F.expr(
        f"a.label < b.label and 100 * a.most >= {percent} * b.least and 100 * b.most >= {percent} * a.least"
        f" and least(a.most - a.pos, b.most - b.pos) * {100 + percent} >= {percent} * (a.least + b.least)"
        f" and (a.size + b.size - ({apart}) + 2 * (a.beyond + b.beyond)) * {100 + percent} >= {2 * percent} * (a.least + b.least)"
    )
    short = blocks.join(parts, "token", "left_anti")
    dealt = blocks.join(parts, "token").withColumn("part", F.pmod(F.xxhash64("pivot"), F.col("parts")).cast("int"))
    spread = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    told = ["a.token", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in columns[:7]]]
    near = short.alias("a").join(short.alias("b"), (F.col("a.token") == F.col("b.token")) & meet).select(*told)
    near = near.unionByName(dealt.alias("a").join(spread.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.part") == F.col("b.part")) & meet).select(*told))
    pair = [F.col("a_pivot").alias("x"), F.col("b_pivot").alias("y"), (F.col("a_beyond") + F.col("b_beyond")).alias("beyond"), (F.col("a_least") + F.col("b_least")).alias("sizes"), (F.col("a_alone") & F.col("b_alone")).alias("alone")]
    near = materialise(near.select("token", *pair, *[F.col(f"b_{c}").alias(f"y_{c}") for c in ("least", "most", "pos", "beyond")]), "blocks")
    # a pair's bound is that of its widest blocks, first by the whole sketches
    asked = near.groupBy("x", "y").agg(F.max("beyond").alias("beyond"), F.min("sizes").alias("sizes"))
    asked = materialise(_alike(asked, sketches, percent, "beyond", "sizes").select("x", "y"), "asked-blocks")
    known = _either_way(verified)
    new = verify(docs, asked.join(known, ["x", "y"], "left_anti"), k)
    answers = materialise(asked.join(known, ["x", "y"]).select("x", "y", "x_n", "y_n", "overlap").unionByName(new), "answers")
    # blocks that hold their pivots alone are answered by them; of the others those stay whose bound is high enough
    open_blocks = near.where("not alone").join(answers.select("x", "y", "overlap"), ["x", "y"]).where(f"(overlap + beyond) * {100 + percent} >= {percent} * sizes")
    open_blocks = materialise(open_blocks.select("token", "x", "y", "overlap", *[F.col(f"y_{c}").alias(f"of_{c}") for c in ("least", "most", "pos", "beyond")]), "open-blocks")
    opened = _only(left, open_blocks.select("token", F.explode(F.array("x", "y")).alias("pivot")))
    x, y = (opened.select("token", F.col("pivot").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "pos", "beyond")]) for side in "xy")
    # each member of the first block against the bounds of the second, then the members that are left against each other
    fits = f"least(overlap + x_beyond + of_beyond, x_n - x_pos, of_most - of_pos) * {100 + percent} >= {percent} * (x_n + of_least) and 100 * x_n >= {percent} * of_least and 100 * of_most >= {percent} * x_n"
    pairs = open_blocks.join(x, ["token", "x"]).where(fits).join(y, ["token", "y"])
    pairs = pairs.where(_possible(percent)).where("x_id <> x or y_id <> y").where(f"(overlap + x_beyond + y_beyond) * {100 + percent} >= {percent} * (x_n + y_n)")
    pairs = pairs.select(F.col("x_id").alias("x"), F.col("y_id").alias("y")).distinct().join(known, ["x", "y"], "left_anti")
    found = verify(docs, _alike(pairs, sketches, percent), k)
    return answers.where(_links(percent)).select("x", "y").unionByName(found.where(_links(percent)).select("x", "y"))


def keep_one(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """`docs`, with all columns, of each component only the document of the smallest id; null ids stay.

    Rows that repeat an id with an equal text are one document. Where ids stand for different texts, each text is judged on
    its own; of two that link under one id that of the smaller key stays.
    """
    if _clashes(docs):
        told = materialise(_by_content(docs, _components, k, percent), "told")
        first = told.where("doc_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first"))
        gone = told.where("n_shingles > 0").join(first, "component_id").where("doc_id is not null and key <> first.key").select(F.col("key").alias("__gone")).distinct()
        mine = _key("doc_id", "text")
    else:
        gone = _components(docs, k, percent).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
        mine = F.col("doc_id").cast("long")
    gone = materialise(gone, "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = docs.withColumn("__key", mine).join(gone, F.col("__key") == F.col("__gone"), "left_anti").withColumn("__text", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():  # rows that came with the same id
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "__text"]).unionByName(kept.where("doc_id is null"))
    return kept.select(*docs.columns)


def query(spark, sf_dir):
    return join_links(read(spark, sf_dir, "documents"))
