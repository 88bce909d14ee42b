"""MinHash near-dedup by chosen-path set similarity join.

A document's set is its distinct word shingles (of five words unless a rule says otherwise), as 64-bit hashes. Documents
with equal sets form one class, and only classes go on. Each class has `COORDINATES` minwise tokens. `TREES` independent
trees branch the classes: at the root of a tree a class chooses one coordinate, and its minwise token there names its
node; a node with more than `SMALL` classes is branched again, each of its classes choosing `BRANCHES` further coordinates,
until `DEPTH`. Two classes with similarity s meet at the root with probability s, and at a level below with
1 - (1 - s)^BRANCHES, so eight trees lose one link of similarity 0.85 in 3.9 million where nodes are small and one in 640,000 where
they are branched twice (at 0.8 one in 390,000 and one in 43,000). Nodes are compared exhaustively, on the shares of equal
minwise tokens: pairs that lie more than `MARGIN` under the threshold, six standard deviations or more, are taken for no links;
that refuses one link in 50 million or fewer, by the binomial tail. What a node emits is no list of pairs but a forest that
connects its candidates, as far as the first tree has not connected them already.

Connected candidates are clusters. Every link lies inside a cluster, and there it is decided on full sets: a cluster is
dealt into blocks of about `BLOCK` classes and each pair of blocks is searched breadth first in one task, which again emits
a forest of links. The same deal serves nodes that are still large at full depth. Components of the forests are found by
contraction, with edges and labels in tables. No task's rows grow with a group of copies, and no step collects documents,
links or components to the driver. The search in a cluster of g different near copies takes (g / BLOCK)^2 / 2 tasks.

Defined cases: null, empty and blank texts have no set and are linked with nothing; with fewer words than a shingle has
the whole sequence is the one shingle; null doc_ids count as larger than all others, so that a component is named by a real id if it
has one; rows that repeat the same (doc_id, text) are one document to the result and each is returned; an empty table
gives an empty result; extra columns are not read, and `dedup` returns all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, lean, scope, stage

OF = 100
COORDINATES = 64
TREES = 8
BRANCHES = 2
DEPTH = 3
SMALL = 4000  # a node's exhaustive comparison takes under a second and 1 MB
BLOCK = 400
MARGIN = 0.3
BROADCAST_KEYS = 500_000
EDGES = 500_000  # that a task of `components` joins
SALTS = 32
KEPT_POWERS = 1 << 17


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the similarity of a link in hundredths."""

    words: int = 5
    percent: int = 80


_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _numbers(name: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(f"{name}{i}".encode(), digest_size=8).digest() for i in range(n)), "<u8").copy()


_BYTE, _MULTIPLY = _numbers("byte", 256), _numbers("multiply", COORDINATES) | np.uint64(1)
_ADD = _numbers("add", COORDINATES)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_kept_powers: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; those that most texts need are kept."""
    kept = _kept_powers.get(int(base))
    if kept is not None and n <= len(kept):
        return kept[:n]
    out = np.full(max(n, KEPT_POWERS), base, np.uint64)
    out[:1] = 1
    out = np.multiply.accumulate(out)
    if len(out) == KEPT_POWERS:
        _kept_powers[int(base)] = out
    return out[:n]


def spelled(raw: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word and where it starts, A-Z folded or not; a polynomial of its bytes, from prefix sums."""
    data = np.frombuffer(raw, np.uint8)
    if fold:
        data = _FOLD[data]
    inside = ~_WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_ODD, len(data)), dtype=np.uint64)))
        # take the power of its place in the text out of every word's sum
        value = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
        return _mix(value ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def word_hashes(raw: bytes) -> np.ndarray:
    return spelled(raw, True)[0]


def shingles(text: str | None, words_each: int) -> np.ndarray:
    """The document's set, sorted."""
    words = word_hashes((text or "").encode())
    n = len(words)
    if not n:
        return words
    k = min(n, words_each)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out * _ODD + words[i : n - k + 1 + i])
    return np.unique(out)


def minwise(values: np.ndarray) -> np.ndarray:
    """The least of the set under each of COORDINATES hash functions, 32 bits of it."""
    least = np.full(COORDINATES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(values), 8192):
            h = values[None, a : a + 8192] * _MULTIPLY[:, None] + _ADD[:, None]
            h ^= h >> np.uint64(32)
            least = np.minimum(least, h.min(1))
    return _mix(least).astype(np.uint32)


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _slim(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text")


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, text_hash, salt, n_shingles, key, sig): key and sig are null where there is no set."""

    def over(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sets = [shingles(t.as_py(), rule.words) for t in part.column(1)]
                keys = [set_key(s) if len(s) else None for s in sets]
                sigs = [minwise(s).tobytes() if len(s) else None for s in sets]
                yield pa.record_batch([part.column(0), part.column(2), part.column(3), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "salt", "n_shingles", "key", "sig"])

    slim = _slim(docs).withColumn("text_hash", F.xxhash64("text"))
    slim = slim.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(3)), F.lit(SALTS)).cast("int"))
    return slim.mapInArrow(lean(over), "doc_id long, text_hash long, salt int, n_shingles long, key binary, sig binary")


def meetings(classes: DataFrame, trees: range) -> DataFrame:
    """(node, key, label, size): the leaves of the trees that hold classes of two labels or more."""
    own = 4 * (DEPTH - 1) * BRANCHES  # a tree's coordinates below its root are its own
    roots = [
        F.struct(
            F.lit(tree).alias("tree"),
            F.xxhash64(F.lit(tree), F.substring("sig", 4 * tree + 1, 4)).alias("node"),
            F.substring("sig", 4 * TREES + tree * own + 1, own).alias("below"),
        )
        for tree in trees
    ]
    rows = classes.select("key", "label", F.explode(F.array(*roots)).alias("r")).select("key", "label", "r.node", "r.below")
    leaves = None
    for level in range(DEPTH):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("_a"), F.max("label").alias("_z"))
        met = stage(rows.join(sizes.where("_a < _z").drop("_a", "_z"), "node"), "near-met")
        large = met.where(F.col("size") > SMALL)
        last = level == DEPTH - 1 or large.isEmpty()
        done = (met if last else met.where(F.col("size") <= SMALL)).select("node", "key", "label", "size")
        leaves = done if leaves is None else leaves.unionByName(done)
        if last:
            return leaves
        step = [F.xxhash64("node", F.lit(b), F.substring("below", 4 * (level * BRANCHES + b) + 1, 4)) for b in range(BRANCHES)]
        rows = large.select("key", "label", "below", F.explode(F.array(*step)).alias("node"))
    return leaves


def dealt(rows: DataFrame, group: str, size: str, member: str, limit: int, block: int) -> DataFrame:
    """Rows with a `task` and their `block`: groups up to `limit` are one task; larger ones are dealt into blocks, a task for
    every two of them."""
    blocks = F.when(F.col(size) <= limit, F.lit(1)).otherwise(F.ceil(F.col(size) / block)).cast("int")
    rows = rows.withColumn("_n", blocks).withColumn("block", F.pmod(F.xxhash64(member, F.lit(5)), F.col("_n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda other: F.xxhash64(F.col(group), F.least(F.col("block"), other), F.greatest(F.col("block"), other)))
    return rows.withColumn("task", F.explode(F.array_distinct(pairs))).drop("_n")


def candidate_forest(sigs: np.ndarray, sizes: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Edges that connect all pairs with enough equal minwise tokens, by breadth-first search over what is left."""
    left = np.arange(len(sigs))
    edges = []
    queue: list[int] = []
    need = (rule.percent / OF - MARGIN) * COORDINATES
    while len(left) or queue:
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        x = queue.pop()
        if not len(left):
            break
        same = (sigs[left] == sigs[x]).sum(1) >= need
        a, b = sizes[left], sizes[x]
        same &= (a * OF >= rule.percent * b) & (b * OF >= rule.percent * a)
        found = left[same]
        edges += [(x, y) for y in found.tolist()]
        queue += found.tolist()
        left = left[~same]
    return edges


def link_forest(sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Edges that connect all linked pairs, decided on full sets, by breadth-first search over what is left."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    bounds = np.concatenate(([0], np.cumsum(size)))
    own = [ids[bounds[k] : bounds[k + 1]] for k in range(n)]
    held = np.zeros(len(tokens), bool)
    waiting = np.ones(n, bool)
    edges, queue = [], []
    open_ids, open_owner, gone = ids, owner, 0
    for first in range(n):
        if not waiting[first]:
            continue
        waiting[first] = False
        queue.append(first)
        while queue:
            x = queue.pop()
            gone += 1
            if gone * 8 > n:  # forget those that have been reached
                keep = waiting[open_owner]
                open_ids, open_owner, gone = open_ids[keep], open_owner[keep], 0
            held[own[x]] = True
            common = np.bincount(open_owner[held[open_ids]], minlength=n)
            held[own[x]] = False
            found = np.flatnonzero(waiting & (OF * common >= rule.percent * (size + size[x] - common)))
            waiting[found] = False
            edges += [(x, y) for y in found.tolist()]
            queue += found.tolist()
    return edges


def _forest(table: pa.Table, search: Callable[[np.ndarray], list[tuple[int, int]]]) -> pa.RecordBatch | None:
    """The edges (a, b) of a task that connect what isn't connected elsewhere: not rows with a common label, nor those that a
    block connects by itself where the task holds two, since each block also is a task of its own. `search` gives a
    forest of the rows with the given numbers."""
    n = table.num_rows
    if n < 2:
        return None
    root = list(range(n))

    def joins(a: int, b: int) -> bool:
        a, b = _root(root, a), _root(root, b)
        root[a] = b
        return a != b

    if "label" in table.column_names:
        first: dict[int, int] = {}
        for i, label in enumerate(table.column("label").to_pylist()):
            joins(i, first.setdefault(label, i))
    block = table.column("block").to_numpy()
    if (block != block[0]).any():
        for k in np.unique(block):
            own = np.flatnonzero(block == k)
            for a, b in search(own):
                joins(int(own[a]), int(own[b]))
    found = [(a, b) for a, b in search(np.arange(n)) if joins(a, b)]
    if not found:
        return None
    names = table.column("key").to_pylist()
    return pa.record_batch([pa.array([names[a] for a, _ in found], pa.binary()), pa.array([names[b] for _, b in found], pa.binary())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(key, label): of every key in the edges (a, b) a key that all which are connected have in common.

    In a round, edges are dealt to tasks and each task joins its own ones: a key gets one root a task. A key's roots belong
    together, which makes the next round's edges, from the first of them, in an order that differs from round to round, to the
    others; whatever is no task's root is settled. The first round deals edges at random, so a hub of any size is spread and
    leaves one edge a task; later ones deal them by their first key, so all that meets in a key becomes one in a round.
    """
    rest = edges.select("a", "b")
    n = rest.count()
    moves: list[DataFrame] = []
    while True:
        turn = len(moves)

        def stars(batches):
            number: dict[bytes, int] = {}
            root: list[int] = []
            for batch in batches:
                for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    a, b = number.setdefault(x, len(number)), number.setdefault(y, len(number))
                    root.extend(range(len(root), len(number)))
                    a, b = _root(root, a), _root(root, b)
                    if a != b:
                        root[a] = b
            if number:
                names = list(number)
                turned = [hashlib.blake2b(x, digest_size=8, salt=turn.to_bytes(4, "little")).digest() for x in names]
                first: dict[int, int] = {}
                tops = [_root(root, k) for k in range(len(names))]
                for k, top in enumerate(tops):
                    if top not in first or turned[k] < turned[first[top]]:
                        first[top] = k
                for a in range(0, len(names), 20_000):
                    yield pa.record_batch([pa.array(names[a : a + 20_000], pa.binary()), pa.array([names[first[t]] for t in tops[a : a + 20_000]], pa.binary())], ["key", "root"])

        tasks = -(-n // EDGES)
        if not turn:
            deal = rest.repartition(max(4, tasks))
        elif tasks > int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            deal = rest.repartition(tasks, "a")
        else:
            deal = rest.repartition("a")
        ordered = F.struct(F.xxhash64("root", F.lit(turn)).alias("h"), "root")
        step = deal.mapInArrow(lean(stars), "key binary, root binary").groupBy("key").agg(F.sort_array(F.collect_set(ordered)).alias("r"))  # one a task at most
        step = stage(step.select("key", "r.root"), "near-roots")
        moves.append(step.select("key", F.col("root")[0].alias("label")))
        rest = step.where("size(root) > 1").select(F.col("root")[0].alias("a"), F.explode(F.slice("root", 2, F.size("root") - 1)).alias("b"))
        n = rest.count()
        if not n:
            break
    labels = moves.pop()
    while moves:
        later = labels.select(F.col("key").alias("_from"), F.col("label").alias("_to"))
        labels = moves.pop().join(later, F.col("label") == F.col("_from"), "left").select("key", F.coalesce("_to", "label").alias("label"))
    return stage(labels, "near-labels")


def _root(root: list[int], a: int) -> int:
    while root[a] != a:
        root[a] = root[root[a]]
        a = root[a]
    return a


def classified(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The `signatures` of every document; the classes (key, sig, n, least, copies, salts), `least` being what names a class and
    `salts` those of its rows; and (key, label) of every class that is linked with another one."""
    rows = stage(signatures(docs, rule), "near-signatures", keep=True)
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.first("sig").alias("sig"),
        F.min("n_shingles").alias("n"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least"),
        F.count(F.lit(1)).alias("copies"),
        F.collect_set("salt").alias("salts"),  # SALTS at most
    )
    classes = stage(classes, "near-classes")

    def candidates(table: pa.Table):
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        sizes = table.column("n").to_numpy()
        return _forest(table, lambda rows: candidate_forest(sigs[rows], sizes[rows], rule))

    def edges(classes: DataFrame, trees: range) -> DataFrame:
        tasks = dealt(meetings(classes, trees), "node", "size", "key", SMALL, SMALL // 2).select("task", "block", "key", "label")
        tasks = tasks.join(classes.select("key", "sig", "n"), "key")
        return stage(grouped(tasks, "task", candidates, "a binary, b binary"), "near-candidates")

    # the first tree connects most of a group of copies; the others only add what it left apart
    first = edges(classes.select("key", "sig", "n", F.xxhash64("key").alias("label")), range(1))
    known = classes.select("key", "sig", "n").join(components(first), "key", "left")
    known = stage(known.withColumn("label", F.xxhash64(F.coalesce("label", "key"))), "near-labelled")
    clusters = components(first.unionByName(edges(known, range(1, TREES))))

    # full sets, of the clusters' classes only
    sizes = clusters.groupBy("label").count().withColumnRenamed("count", "size")
    members = stage(clusters.join(sizes, "label").join(classes.select("key", "least.doc_id"), "key"), "near-members")
    few = members.count() <= BROADCAST_KEYS
    wanted = members.select(F.col("doc_id").alias("_w")).distinct()
    texts = _slim(docs)
    texts = texts.join(F.broadcast(wanted) if few else wanted, texts["doc_id"].eqNullSafe(F.col("_w")), "left_semi")

    def sets(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                found = [s for t in batch.column(1).slice(a, 512) if len(s := shingles(t.as_py(), rule.words))]
                yield pa.record_batch([pa.array([set_key(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["key", "set"])

    full = texts.mapInArrow(lean(sets), "key binary, set binary").join(members.select("key", "label", "size"), "key")
    full = full.groupBy("key").agg(F.first("set").alias("set"), F.first("label").alias("label"), F.first("size").alias("size"))

    def links(table: pa.Table):
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        return _forest(table, lambda rows: link_forest([sets[i] for i in rows], rule))

    found = grouped(dealt(full, "label", "size", "key", BLOCK, BLOCK).select("task", "block", "key", "set"), "task", links, "a binary, b binary")
    return rows, classes, components(stage(found, "near-links"))


def near_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, first) of every document; `first` marks the one text that stays of a
    component, also where ids are null or repeated."""
    with scope():
        rows, classes, links = classified(docs, rule)
        named = links.join(classes.select("key", "least"), "key").groupBy("label").agg(F.min("least").alias("named"))
        linked = links.join(named, "label").select("key", "named")
        many = classes.select("key", "least", "copies", "salts").join(linked, "key", "left").where("copies > 1 OR named IS NOT NULL")
        # a class may hold a third of all rows: it has a row here for each salt of its documents
        many = many.select(F.col("key").alias("_k"), F.coalesce("named", "least").alias("_c"), F.explode("salts").alias("_s"))
        many = stage(many, "near-named", keep=True)
    out = rows.select("doc_id", "text_hash", "salt", "n_shingles", "key").join(many, (F.col("key") == F.col("_k")) & (F.col("salt") == F.col("_s")), "left")
    grouped_up = F.col("_c").isNotNull()
    component = F.when(grouped_up, F.col("_c.doc_id")).otherwise(F.col("doc_id"))
    first = F.when(grouped_up, F.col("doc_id").eqNullSafe(F.col("_c.doc_id")) & (F.col("text_hash") == F.col("_c.text_hash"))).otherwise(True)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", first.alias("first"))


def dedup(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One document of each component, the one that names it, with all its columns; rows that repeat its id and text stay with it."""
    with scope():
        gone = near_groups(docs, rule).where("NOT first").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
        gone = stage(gone, "near-gone", keep=True)
    few = gone.count() <= BROADCAST_KEYS
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_hash"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
