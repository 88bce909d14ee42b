"""Packing documents into sequences of bounded length by a grouping genetic algorithm.

A document's ids are cut into pieces only where it is longer than a sequence; pieces of full length are sequences of their
own. The other pieces are dealt at random into blocks of about `BLOCK` pieces, each packed by itself. A chromosome is a
whole packing of a block, its genes are bins. Crossover injects whole well-filled bins of one parent into the other,
drops the bins that hold the same pieces, and best-fits the pieces that this displaced. Every block has `ISLANDS`
populations, one row each, that evolve in separate tasks; after each epoch the best packing of an island moves on to the
next one, and after the last the best of all islands is taken. Fitness is the number of bins, then the sum of squared
fills.

Blocks are bounded, so no task grows with the input; what a block loses at its end is at most part of one sequence in
about two thousand.

Defined cases: a null or empty text is the closing id alone; repeated rows are separate documents; equal lengths are
told apart by the piece's row number; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_codec import portions
from .common import lean, stage, unstage

CAPACITY = 2048
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 8
POPULATION = 4
CACHE_WORDS = 500_000


class WordTokenizer:
    """Ids of whole texts as the library gives them, by a bounded table of words that the library has encoded.

    The table serves texts without characters beyond U+024F, for which normalizing is lower-casing and the splitting
    pattern can be written out; all others, and those with a special string, go through the library whole.
    """

    _made: dict = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

        def span(kind):
            return "".join(re.escape(chr(c)) for c in range(0x250) if regex.match(kind, chr(c)))

        letters, numbers, white = span(r"\p{L}"), span(r"\p{N}"), r"\x09-\x0d \x85\xa0"
        self.find = re.compile(f"'(?:[stmd]|re|ve|ll)|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+").findall
        self.beyond = re.compile("[^\x00-ɏ]").search
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words, many to a call: parted by spaces they split as they do alone, and a word's last id says so."""
        out: list[bytes] = []
        for a in range(0, len(words), 2000):
            ids = np.frombuffer(self._library([" ".join(words[a : a + 2000])])[0], "<u4")
            ends = (np.flatnonzero(self.is_end[ids]) + 1).tolist()
            if len(ends) != len(words[a : a + 2000]):
                out += self._library(words[a : a + 2000])
                continue
            raw, first = ids.tobytes(), 0
            for e in ends:
                out.append(raw[4 * first : 4 * e])
                first = e
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(texts)
        split, at, whole = [], [], []
        for i, t in enumerate(texts):
            if not t.isascii() and self.beyond(t) or "<|" in t and any(s in t for s in self.special):
                whole.append(i)
            else:
                split.append(self.find(t.lower()))
                at.append(i)
        new = set().union(*split).difference(self.words)
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words = {}
            new = set().union(*split)
        if new:
            words = list(new)
            self.words.update(zip(words, self._words(words)))
        known = self.words.__getitem__
        for i, words in zip(at, split):
            out[i] = b"".join(map(known, words))
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids
        return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the closing id, cut only beyond `capacity`."""

    def over(batches):
        tokenizer = WordTokenizer.of(path)
        end = np.array([closing], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            k = 0
            for texts in portions(batch.column(1)):
                for ids in tokenizer.encode(texts):
                    ids += end
                    for p, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        row.append(k), piece.append(p), start.append(a // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    k += 1
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            yield pa.record_batch([*columns, *(pa.array(x, pa.int64()) for x in (start, length, crc))], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    slim = docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text")
    return slim.mapInArrow(lean(over), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of piece numbers, and what is free in each."""

    def __init__(self, bins: list[list[int]], free: list[int]):
        self.bins, self.free = bins, free

    def fitness(self, capacity: int) -> tuple[int, int]:
        return -len(self.bins), sum((capacity - f) ** 2 for f in self.free)

    def add(self, items, sizes: list[int], capacity: int) -> Packing:
        """Best fit: each item into the fullest bin that still takes it."""
        at: dict[int, list[int]] = {}
        mask = 0  # bit f: some bin has f free
        for b, f in enumerate(self.free):
            at.setdefault(f, []).append(b)
            mask |= 1 << f
        for item in items:
            size = sizes[item]
            fits = mask >> size
            if fits:
                f = size + (fits & -fits).bit_length() - 1
                same = at[f]
                b = same.pop()
                if not same:
                    mask &= ~(1 << f)
                self.bins[b].append(item)
            else:
                f, b = capacity, len(self.bins)
                self.bins.append([item])
                self.free.append(capacity)
            left = self.free[b] = f - size
            at.setdefault(left, []).append(b)
            mask |= 1 << left
        return self

    def assignment(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out

    @staticmethod
    def of(assignment: np.ndarray, sizes: list[int], capacity: int) -> Packing:
        n = int(assignment.max()) + 1 if len(assignment) else 0
        bins: list[list[int]] = [[] for _ in range(n)]
        free = [capacity] * n
        for item, b in enumerate(assignment.tolist()):
            bins[b].append(item)
            free[b] -= sizes[item]
        return Packing(bins, free)


def crossover(into: Packing, giver: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Whole well-filled bins of `giver` go into `into`; bins with the same pieces go, and what they displaced is best-fitted."""
    order = sorted(range(len(giver.bins)), key=giver.free.__getitem__)
    full = order[: max(1, int(len(order) * rng.uniform(0.3, 0.8)))]
    share = rng.uniform(0.3, 0.95)
    chosen = [b for b in full if rng.random() < share]
    taken = {i for b in chosen for i in giver.bins[b]}
    child, displaced = Packing([list(giver.bins[b]) for b in chosen], [giver.free[b] for b in chosen]), []
    for items, free in zip(into.bins, into.free):
        if taken.isdisjoint(items):
            child.bins.append(list(items))
            child.free.append(free)
        else:
            displaced += [i for i in items if i not in taken]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return child.add(displaced, sizes, capacity)


def mutate(p: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """The emptiest bins and a few others are taken apart and best-fitted again."""
    order = sorted(range(len(p.bins)), key=p.free.__getitem__, reverse=True)
    gone = set(order[: max(2, len(order) // 50)]) | {rng.randrange(len(p.bins)) for _ in range(len(order) // 50)}
    loose = [i for b in gone for i in p.bins[b]]
    rng.shuffle(loose)
    loose.sort(key=lambda i: sizes[i] + rng.uniform(-0.1, 0.1) * capacity, reverse=True)
    keep = [b for b in range(len(p.bins)) if b not in gone]
    return Packing([list(p.bins[b]) for b in keep], [p.free[b] for b in keep]).add(loose, sizes, capacity)


def evolve(sizes: list[int], seeds: list[np.ndarray], capacity: int, rng: random.Random, generations: int) -> np.ndarray:
    """The best packing of one island's epoch. It ends early once no packing could have fewer bins."""
    least = -(-sum(sizes) // capacity)
    people = [Packing.of(s, sizes, capacity) for s in seeds]
    by_size = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    while len(people) < POPULATION:
        spread = 0.0 if not people else rng.uniform(0.02, 0.3) * capacity
        order = sorted(by_size, key=lambda i: sizes[i] + rng.uniform(-spread, spread), reverse=True) if spread else by_size
        people.append(Packing([], []).add(order, sizes, capacity))
    for _ in range(generations):
        people.sort(key=lambda p: p.fitness(capacity), reverse=True)
        if len(people[0].bins) <= least:
            break
        a, b = rng.sample(range(len(people)), 2)
        children = [crossover(people[a], people[b], sizes, capacity, rng), crossover(people[0], people[rng.randrange(1, len(people))], sizes, capacity, rng)]
        children.append(mutate(people[0], sizes, capacity, rng))
        people = sorted(people + children, key=lambda p: p.fitness(capacity), reverse=True)[:POPULATION]
    return max(people, key=lambda p: p.fitness(capacity)).assignment(len(sizes))


def _epoch(rows: DataFrame, epoch: int, capacity: int, generations: int) -> DataFrame:
    """(block, island, sizes, best, bins, fill) after one more epoch of (block, island, sizes, seeds)."""

    def over(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sizes = np.frombuffer(r["sizes"], "<i4").tolist()
                rng = random.Random(f"{r['block']}/{r['island']}/{epoch}")
                best = evolve(sizes, [np.frombuffer(s, "<i4") for s in r["seeds"] or []], capacity, rng, generations)
                bins, fill = Packing.of(best, sizes, capacity).fitness(capacity)
                out.append({"block": r["block"], "island": r["island"], "sizes": r["sizes"], "best": best.astype("<i4").tobytes(), "bins": -bins, "fill": fill})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("best", pa.binary()), ("bins", pa.int64()), ("fill", pa.int64())]))

    tasks = 3 * rows.sparkSession.sparkContext.defaultParallelism  # so small that they would be put together
    return rows.repartition(tasks, "block", "island").mapInArrow(lean(over), "block long, island int, sizes binary, best binary, bins long, fill long")


def pack(cut: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """`cut` pieces with (sequence_id, offset)."""
    cut = stage(cut.withColumn("_pid", F.monotonically_increasing_id()), "pack-pieces")
    part = cut.where(F.col("length") < capacity)
    blocks = max(1, -(-part.count() // BLOCK))
    part = part.withColumn("_block", F.pmod(F.xxhash64("_pid"), F.lit(blocks)))
    part = stage(
        part.withColumn("_at", F.row_number().over(Window.partitionBy("_block").orderBy(F.desc("length"), "_pid")) - 1), "pack-dealt"
    )
    sizes = part.groupBy(F.col("_block").alias("block")).agg(F.sort_array(F.collect_list(F.struct("_at", "length"))).alias("_l"))  # about BLOCK each

    def as_bytes(batches):
        for batch in batches:
            data = [np.array([x["length"] for x in r["_l"]], "<i4").tobytes() for r in batch.to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], ["block", "sizes"])

    rows = sizes.mapInArrow(lean(as_bytes), "block long, sizes binary").select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", F.lit(None).cast("array<binary>").alias("seeds")
    )
    old = None
    for epoch in range(epochs):
        done = stage(_epoch(rows, epoch, capacity, generations), "pack-epoch")
        if old is not None:
            unstage(old)
        moved = done.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("best").alias("came"))
        rows = done.join(moved, ["block", "island"]).select("block", "island", "sizes", F.array("best", "came").alias("seeds"))
        old = done
    best = old.groupBy("block").agg(F.max_by(F.struct("sizes", "best"), F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("b"))

    def place(batches):
        for batch in batches:
            for r in batch.to_pylist():
                length = np.frombuffer(r["sizes"], "<i4").astype(np.int64)
                at = np.frombuffer(r["best"], "<i4")
                order = np.argsort(at, kind="stable")
                ends = np.cumsum(length[order])
                starts = ends - length[order]
                first = np.r_[True, at[order][1:] != at[order][:-1]]
                offset = np.empty(len(at), np.int64)
                offset[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
                block = np.full(len(at), r["block"], np.int64)
                yield pa.record_batch([block, np.arange(len(at), dtype=np.int32), (block << 24 | at) * 2, offset], ["_block", "_at", "sequence_id", "offset"])

    placed = best.select("block", "b.sizes", "b.best").mapInArrow(lean(place), "_block long, _at int, sequence_id long, offset long")
    whole = cut.where(F.col("length") >= capacity).withColumn("sequence_id", F.col("_pid") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return part.join(placed, ["_block", "_at"]).drop("_block", "_at", "_pid").unionByName(whole.drop("_pid"))
