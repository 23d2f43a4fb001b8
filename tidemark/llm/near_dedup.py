"""MinHash near-duplicates by a chosen-path set similarity join.

A text's set holds its distinct 5-word shingles (64-bit). Texts with equal sets collapse to one representative. The
representatives go through independent trees: a node is a path of chosen minwise tokens; a node of few members is
compared exhaustively on sketches, a larger one is branched by the next tokens of its members. What the sketches join
makes candidate components, and inside these the full sets decide, so a reported link is never an estimate.

A node of more than SMALL members first links what passes the sketch of its first member, as all members of a large group
of near copies do. The rest, if it is few, meets every member in blocks; if it is more than SMALL, the node branches, with
all its members. So a group of near copies of any size is compared in time linear in it.

Recall. The root of each tree branches on two tokens, each further level on two that the path hasn't used. A pair of
similarity s shares a given root node with chance s, and then a node d levels below it with (1 - (1 - s) ** 2) ** d at
least, so it meets in none of the 2 * TREES roots' subtrees with chance (1 - s * (1 - (1 - s) ** 2) ** d) ** (2 * TREES):
3e-7 at 0.85 where no node branches, 6e-6 if all branch four levels deep; at 0.8 it is 3e-6 and 1.1e-4. The sketch of
128 positions passes pairs from four standard deviations under the threshold on. Nodes that the depth limit leaves large,
and large candidate components, are compared in blocks, every block with every other, so no partner is dropped.

Null or empty texts and texts without words have an empty set, are linked with nothing and are kept. A null doc_id
can't be a component: its row comes back with a null component and kept true. Rows that repeat a doc_id are one
document with the links of all its texts, and each row has its component; removal decides on each text by itself, so of
no group of near copies the last text goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, by_group, components, lean, small_side, written
from .kernels import U, shingle_sets, stream

#: Positions of the sketch, minwise tokens for paths, trees, branches of a node.
SKETCH, TOKENS, TREES, BRANCHES = 128, 16, 4, 2
#: Members of a node up to which it is compared exhaustively, levels under the root, members of a block of the rest.
SMALL, DEPTH, BLOCK = 4096, 4, 2048
#: Shingles of a component up to which one task compares it whole, and of a block of a larger one.
WHOLE = 4_000_000
#: A pair passes the sketch if its agreement is at most so many standard deviations under the threshold.
DEVIATIONS = 4.0

_A = stream(21, SKETCH) | U(1)
_B = stream(22, SKETCH)
_SIGNED = "doc_id long, text_hash long, n_shingles long, digest binary, sketch binary, tokens array<long>"


def named(shingles: np.ndarray) -> bytes:
    """What stands for a set."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def minwise(shingles: np.ndarray) -> np.ndarray:
    best = np.full(SKETCH, ~U(0), np.uint64)
    for at in range(0, len(shingles), 4096):
        v = (shingles[at : at + 4096, None] ^ _B) * _A
        v ^= v >> U(32)
        np.minimum(best, v.min(axis=0), out=best)
    return best


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, sketch, tokens) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sketch, tokens = [], [], [], []
            for s in shingle_sets(batch.column(2)):
                n.append(len(s))
                if len(s):
                    low = minwise(s)
                    digest.append(named(s))
                    sketch.append((low & U(0xFFFF)).astype(np.uint16).tobytes())
                    tokens.append(low[:TOKENS].view(np.int64))
                else:
                    digest.append(None), sketch.append(None), tokens.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "digest", "sketch", "tokens"])

    return docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text").mapInArrow(lean(run), _SIGNED)


def joined(adjacent, n: int) -> np.ndarray:
    """Component labels (smallest index) of 0..n-1; adjacent(i, rest) tells which of rest are linked with i."""
    label = np.full(n, -1, np.int64)
    rest = np.arange(n)
    while len(rest):
        seed, rest = int(rest[0]), rest[1:]
        label[seed] = seed
        todo = [seed]
        while todo and len(rest):
            near = adjacent(todo.pop(), rest)
            if near.any():
                found = rest[near]
                label[found] = seed
                rest = rest[~near]
                todo.extend(found.tolist())
    return label


def _least(threshold: float) -> int:
    """Positions of the sketch in which a pair agrees at least."""
    return int(np.floor(SKETCH * (threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / SKETCH))))


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SKETCH)


def _passes_first(threshold: float):
    """Whether each member of a node passes the sketch of the node's first one."""
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, first_n = (batch.column(c).to_numpy() for c in ("n_shingles", "first_n"))
            alike = (_sketches(batch.column("sketch")) == _sketches(batch.column("first_sketch"))).sum(axis=1) >= least
            alike &= np.minimum(n, first_n) >= threshold * np.maximum(n, first_n) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("doc_id"), batch.column("first"), pa.array(alike)], ["node", "doc_id", "first", "alike"])

    return run


def _node_edges(threshold: float):
    least = _least(threshold)

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node = table.column("node").combine_chunks().to_numpy()
        ids = table.column("doc_id").combine_chunks().to_numpy()
        count = table.column("n_shingles").combine_chunks().to_numpy()
        sketch = _sketches(table.column("sketch"))
        cut = np.flatnonzero(np.diff(node, prepend=~node[0], append=~node[-1]))
        left, right = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            own, size, who = sketch[a:b], count[a:b], ids[a:b]
            label = joined(lambda i, rest: (np.minimum(size[rest], size[i]) >= threshold * np.maximum(size[rest], size[i]) - 1e-9) & ((own[rest] == own[i]).sum(axis=1) >= least), b - a)
            linked = np.flatnonzero(label != np.arange(b - a))
            left.append(who[linked])
            right.append(who[label[linked]])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return run


def candidate_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """A forest over representatives that joins all pairs which share a node and pass the sketch."""
    roots = F.array(*[F.struct(F.xxhash64(F.lit(t), F.lit(k), F.col("tokens")[t * BRANCHES + k]).alias("node"), F.array(F.lit(t * BRANCHES + k)).alias("used")) for t in range(TREES) for k in range(BRANCHES)])
    level = reps.select("doc_id", F.explode(roots).alias("n")).select("doc_id", "n.node", "n.used")
    rows = reps.count() * TREES * BRANCHES
    ready, direct = [], []
    for depth in range(DEPTH + 1):
        size = written(level.groupBy("node").count().where("count > 1"), "nodes", rows)
        shared = written(level.join(size, "node"), "level", rows)
        ready.append(shared.where(F.col("count") <= SMALL).select("node", "doc_id"))
        large = shared.where(F.col("count") > SMALL).select("node", "doc_id", "used", "count")
        if large.isEmpty():
            break
        seen = large.select("node", "doc_id").join(reps.select("doc_id", "n_shingles", "sketch"), "doc_id")
        first = large.groupBy("node").agg(F.min("doc_id").alias("first")).join(reps.select(F.col("doc_id").alias("first"), F.col("n_shingles").alias("first_n"), F.col("sketch").alias("first_sketch")), "first")
        first = small_side(written(first, "first"), 50_000)
        alike = written(seen.join(first, "node").mapInArrow(lean(_passes_first(threshold)), "node long, doc_id long, first long, alike boolean"), "alike", rows)
        direct.append(alike.where("alike and doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
        apart = written(alike.groupBy("node").agg(F.count_if(~F.col("alike")).alias("apart"), F.count("*").alias("count")).where("apart > 0"), "apart", rows)
        few = F.lit(True) if depth == DEPTH else F.col("apart") <= SMALL
        blocks = F.ceil(F.col("count") / BLOCK).cast("int")
        meet = alike.join(small_side(apart.where(few & (F.col("apart") <= SMALL)).withColumn("blocks", blocks)), "node")
        one = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int")
        every = F.when(F.col("alike"), F.array(one)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        ready.append(meet.select("node", "doc_id", F.explode(every).alias("b")).select(F.xxhash64("node", "b").alias("node"), "doc_id"))
        if depth == DEPTH:
            rest = alike.join(small_side(apart.where(F.col("apart") > SMALL).select("node", blocks.alias("blocks"))), "node")
            ready.append(in_blocks(rest.select("node", "doc_id", "blocks"), "node"))
            break
        branching = small_side(apart.where(~few).select("node"))
        large = large.join(branching, "node").select("node", "doc_id", "used").join(reps.select("doc_id", "tokens"), "doc_id")
        free = F.array_except(F.array(*[F.lit(i) for i in range(TOKENS)]), F.col("used"))
        pick = F.pmod(F.xxhash64("node", F.lit(0)), F.size("free")).cast("int")
        picks = F.array(*[F.get("free", F.pmod(pick + k, F.size("free"))) for k in range(BRANCHES)])
        level = large.withColumn("free", free).withColumn("at", F.explode(picks))
        level = level.select("doc_id", F.xxhash64("node", "at", F.col("tokens")[F.col("at")]).alias("node"), F.concat("used", F.array("at")).alias("used"))
        rows = BRANCHES * large.count()
    members = reduce(DataFrame.unionByName, ready).join(reps.select("doc_id", "n_shingles", "sketch"), "doc_id")
    found = by_group(members.select("node", "doc_id", "n_shingles", "sketch"), "node", _node_edges(threshold), "a long, b long")
    return reduce(DataFrame.unionByName, direct, found)


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Deal the members of a large group out to pairs of blocks; column blocks tells their number, 1 leaves the group whole.

    Each block meets every other, so a group of any size is compared in full by tasks of bounded size.
    """
    own = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))
    # with several blocks, a block meets itself in its pairs with others
    return rows.where("blocks = 1 or own <> other").withColumn(key, F.when(F.col("blocks") == 1, F.col(key)).otherwise(pair)).drop("own", "other", "blocks")


def _exact_edges(percent: int):
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = table.column("component").combine_chunks().to_numpy()
        ids = table.column("doc_id").combine_chunks().to_numpy()
        raw = table.column("shingles").to_pylist()
        cut = np.flatnonzero(np.diff(group, prepend=~group[0], append=~group[-1]))
        left, right = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            size = np.array([len(x) // 8 for x in raw[a:b]])
            known, flat = np.unique(np.frombuffer(b"".join(raw[a:b]), np.uint64), return_inverse=True)
            start = np.append(0, np.cumsum(size))
            inside = np.zeros(len(known), bool)

            def adjacent(i: int, rest: np.ndarray, size=size, flat=flat, start=start, inside=inside) -> np.ndarray:
                out = 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
                able = rest[out]
                if not len(able):
                    return out
                mine = flat[start[i] : start[i + 1]]
                inside[mine] = True
                length = size[able]
                first = np.append(0, np.cumsum(length)[:-1])
                at = np.repeat(start[able] - first, length) + np.arange(int(length.sum()))
                both = np.add.reduceat(inside[flat[at]].astype(np.int64), first)
                inside[mine] = False
                out[out] = 100 * both >= percent * (length + size[i] - both)
                return out

            label = joined(adjacent, b - a)
            linked = np.flatnonzero(label != np.arange(b - a))
            who = ids[a:b]
            left.append(who[linked])
            right.append(who[label[linked]])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return run


def _with_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, component, blocks, shingles) of texts (doc_id, component, blocks, digest, text) whose set is the named one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # sets are larger than texts
                part = batch.slice(at, 256)
                sets = list(shingle_sets(part.column(4)))
                # another text of a repeated doc_id
                own = pa.array([named(s) == d for s, d in zip(sets, part.column(3).to_pylist(), strict=True)], pa.bool_())
                out = pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "component", "blocks", "shingles"])
                yield out.filter(own)

    return docs.select("doc_id", "component", "blocks", "digest", "text").mapInArrow(lean(run), "doc_id long, component long, blocks int, shingles binary")


def _classes(docs: DataFrame, percent: int, united: bool) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, text_hash, n_shingles, digest), classes (digest, class_id, component_id)) of docs (doc_id, text).

    A class is the texts with equal sets; its vertex is the row of its smallest doc_id, so that texts of a repeated
    doc_id stay apart. united: classes that share a doc_id are linked.
    """
    every = written(signed(docs).withColumn("row", F.monotonically_increasing_id()), "signed")
    total = every.count()
    known = every.where("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    classes = written(classes.select("digest", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("vertex")), "classes", total)
    chosen = known.join(classes, "digest").where("row = vertex")
    reps = written(chosen.select(F.col("vertex").alias("doc_id"), "class_id", "digest", "n_shingles", "sketch", "tokens"), "reps", 20 * total)
    count = reps.count()
    several = known.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"))
    several = written(several.where("n > 1").select("doc_id", (F.col("a") != F.col("b")).alias("differ")), "several", total)

    near = written(components(candidate_edges(reps.drop("class_id", "digest"), percent / 100), "candidates"), "near", count)
    vertices = near.join(reps.select(F.col("doc_id").alias("id"), "class_id", "digest", "n_shingles"), "id")
    size = vertices.groupBy("component").agg(F.sum("n_shingles").alias("n"))
    size = size.withColumn("blocks", F.when(F.col("n") <= WHOLE, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / WHOLE)).cast("int")).drop("n")
    members = vertices.join(written(size, "sizes", count), "component").select(F.col("class_id").alias("doc_id"), F.col("id").alias("vertex"), "component", "blocks", "digest")
    members = small_side(written(members, "members", count))
    texts = docs.join(members, "doc_id").select(F.col("vertex").alias("doc_id"), "component", "blocks", "digest", "text", F.col("doc_id").alias("_id"))
    repeated = not several.isEmpty()
    if repeated:  # a class is compared by one of its rows
        again = texts.join(small_side(several.select(F.col("doc_id").alias("_id"))), "_id", "left_semi").drop("_id")
        texts = texts.join(small_side(several.select(F.col("doc_id").alias("_id"))), "_id", "left_anti").drop("_id")
        sets = _with_sets(texts).unionByName(_with_sets(again).dropDuplicates(["doc_id"]))
    else:
        sets = _with_sets(texts)
    links = by_group(in_blocks(sets, "component"), "component", _exact_edges(percent), "a long, b long", rows=1024)
    if united and repeated:
        shared = known.join(small_side(several.where("differ").select("doc_id")), "doc_id").join(classes, "digest").select("doc_id", "vertex").distinct()
        least = shared.groupBy("doc_id").agg(F.min("vertex").alias("b"))
        links = links.unionByName(shared.join(least, "doc_id").select(F.col("vertex").alias("a"), "b"))
    found = written(components(links, "links"), "linked", count)
    joined = classes.join(found.withColumnRenamed("id", "vertex"), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    least = joined.groupBy("component").agg(F.min("class_id").alias("component_id"))
    return every.select("doc_id", "text_hash", "n_shingles", "digest"), written(joined.join(least, "component").select("digest", "class_id", "component_id"), "class", total)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id (smallest doc_id with the same set).

    percent: documents are linked if 100 * intersection >= percent * union of their shingle sets.
    """
    every, classes = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), percent, True)
    out = every.join(classes, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the rows whose text is a near duplicate of one of a smaller doc_id, by components of texts."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every, classes = _classes(own, percent, False)
    gone = every.join(classes, "digest").where("component_id < doc_id").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    docs, back = aside(docs, "doc_id", "text")
    same = (F.col("doc_id") == F.col("_gone")) & (text_hash(F.col("text").cast("string")) == F.col("_hash"))
    return back(docs.join(small_side(written(gone, "gone")), same, "left_anti"))
