"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut after each line and, inside lines, after white space wherever the gear hash of the last `WINDOW` bytes has
`MASK_BITS` zero bits; white space alone is no chunk and belongs to the one before it. The hash sees nothing before its window
and no other line, so an insertion moves no later cut and a passage gets the same inner cuts wherever it stands. Chunks are
deduplicated by digest: one copy stays, the first one in the document whose key is least, which is the same document for all
chunks of a passage. Chance repeats of a few words are no duplicates, so what is removed are runs of neighbouring repeated
chunks that together hold `MIN_RUN_WORDS` words or more, and that repeat together: neighbours are joined where both lie in a
stretch of the run, of `JOINED_WORDS` words or more, which stands in another place too, in this order and without a gap; a run
goes if some chunks that are joined hold `MIN_RUN_WORDS` words. Chunks that repeat one by one in unrelated documents are no run.
A chunk that repeats by chance right beside a passage goes with it. Where a passage starts or ends inside a line, a few words
up to its nearest cut stay.

Digests have 64 bits, hashed from the chunk's words. No text goes by a collision alone, since a run also needs a repeated stretch of four chunks or so: only a
chunk right beside a true passage could go wrongly, with a probability of the number of chunks in 2^64.

All that is shuffled for every different chunk of a document is its digest and the document's key, two numbers,
pre-aggregated per task; repeats inside a document are found where it is read. The digests that several documents have then
form two bit maps of at most `exact_dedup.MAX_BITS` bits each, which are broadcast to drop the other chunks where they are; only
chunks that pass are joined with their digest's staying document, by a shuffle, or by broadcast where more than `HOT` documents
have the digest, so no line or passage fills a task. The stretches of the runs that come out form bit maps again, so that of all others' stretches
only the same ones are shuffled: the least stretch from each chunk on, and the least one up to each chunk where that is
another (`stretches`), which cover what any longer stretch covers. The runs found are joined to the
documents by broadcast while they number at most `BROADCAST_RUNS` (16 bytes each), so that no text moves; beyond that by a
shuffle on the document's key.

Defined cases: null stays null and has no chunks; empty texts and texts without white space are left alone unless all of
them repeats; rows with the same (doc_id, text) are one document and get the same result; an empty table gives an empty
result; `strip` keeps every column.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import lean, scope, stage
from .exact_dedup import bit_maps, in_maps, map_bits
from .near_dedup import _INVERSE, _ODD, _mix, _powers, spelled

WINDOW = 16
MASK_BITS = 2
MIN_RUN_WORDS = 25
JOINED_WORDS = 16  # about four chunks
BROADCAST_RUNS = 200_000
HOT = 1000

_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8, person=b"gear").digest() for b in range(256)), "<u8")
_GEAR_LOW = (_GEAR & np.uint64(0xFFFF)).astype(np.uint16)  # cuts look at the highest of the low WINDOW bits
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def rolling(data: np.ndarray) -> np.ndarray:
    """The low 16 bits of the gear hash of the WINDOW bytes up to each byte: the sum of gear[b] << age, by doubling."""
    h = _GEAR_LOW[data]
    width = 1
    while width < WINDOW:
        older = h[:-width] << np.uint16(width) if len(h) > width else h[:0]
        h = h.copy()
        h[width:] += older
        width *= 2
    return h


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks. The hash's high bits mix most bytes of the window."""
    if not len(data):
        return np.empty(0, np.int64)
    at = np.flatnonzero(_WHITE[data])
    line = data[at] == 10
    begun = np.maximum.accumulate(np.where(line, at + 1, 0))  # where each one's line, or the next one's, starts
    marked = (rolling(data)[at] >> np.uint16(WINDOW - MASK_BITS)) & np.uint16((1 << MASK_BITS) - 1) == 0
    ends = at[line | marked & (at + 1 - begun >= WINDOW)] + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    written = np.cumsum(~_WHITE[data])[ends - 1]  # so far
    ends = ends[np.append(written[1:] > written[:-1], True)]  # the next chunk has a word
    return ends[1:] if len(ends) > 1 and written[0] == 0 else ends


def _joint(hashes: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of hashes, a polynomial from prefix sums."""
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_ODD, len(hashes)), dtype=np.uint64)))
        # take the power of its place out of every range's sum
        value = (sums[past] - sums[first]) * _powers(_INVERSE, len(hashes) + 1)[first]
        return _mix(value ^ (past - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def digests(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digest of every chunk's words, whatever white space parts them, and their number."""
    words, starts = spelled(raw, False)
    past = np.searchsorted(starts, ends)  # words that start before
    first = np.concatenate((np.zeros(1, np.int64), past[:-1])) if len(past) else past
    return _joint(words, first, past).view(np.int64), (past - first).astype(np.int32)


def _key() -> Column:
    """The document's key, of its id and its text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_k")


def stretches(found: np.ndarray, words: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, first and last chunk of the least stretch of `need` words from each chunk on, and of the least one up to each
    chunk that ends none of these. Whether a stretch is one of them depends on its own chunks only."""
    n = len(found)
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(words, dtype=np.int64)))
    ends = np.searchsorted(sums, sums[:-1] + need)  # past the last chunk
    first = np.flatnonzero(ends <= n)
    past = np.flatnonzero(sums >= need)
    begins = np.searchsorted(sums, sums[past] - need, "right") - 1
    other = ends[begins] != past
    first, past = np.concatenate((first, begins[other])), np.concatenate((ends[first], past[other]))
    return _joint(found.view(np.uint64), first, past).view(np.int64), first, past - 1


def chunks(docs: DataFrame, joined_words: int = JOINED_WORDS) -> DataFrame:
    """(_k, digests, words, stretches, doubled): the chunks of every document, in order, their words (negative where the chunk
    stands earlier in the document), the different digests of its stretches, and those that it has twice."""

    def over(batches):
        for batch in batches:
            found, counted, joined, doubled = [], [], [], []
            for t in batch.column(1):
                raw = (t.as_py() or "").encode()
                d, w = digests(raw, cuts(np.frombuffer(raw, np.uint8)))
                once, times = np.unique(stretches(d, w, joined_words)[0], return_counts=True)
                joined.append(once), doubled.append(once[times > 1])
                later = np.ones(len(d), bool)
                later[np.unique(d, return_index=True)[1]] = False
                found.append(d), counted.append(np.where(later, -w, w))
            columns = [pa.array(found, _LONGS), pa.array(counted, pa.list_(pa.int32())), pa.array(joined, _LONGS), pa.array(doubled, _LONGS)]
            yield pa.record_batch([batch.column(0), *columns], ["_k", "digests", "words", "stretches", "doubled"])

    slim = docs.select(_key(), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lean(over), "_k long, digests array<long>, words array<int>, stretches array<long>, doubled array<long>")


def _among(places: DataFrame, own: DataFrame) -> DataFrame:
    """The places whose digest is one of `own`'s, and by a chance of the bit maps a few more."""
    bits = map_bits(own.count())
    return in_maps(places, bit_maps(own, "digest", bits), "digest", bits).where("maybe").drop("maybe")


def _met(places: DataFrame, own: DataFrame) -> DataFrame:
    """`places` joined with `own` (digest, owner, n), a staged table, on the digest. Places of digests that more than HOT
    documents have are joined by broadcast, since there are few such digests, and spread over the shuffle of the others."""
    hot = own.where(F.col("n") > HOT).select(F.col("digest").alias("_h"), F.col("owner").alias("_f"))
    if not 0 < hot.count() <= BROADCAST_RUNS:
        return places.join(own.select("digest", "owner"), "digest")
    marked = places.join(F.broadcast(hot), F.col("digest") == F.col("_h"), "left")
    key = F.when(F.col("_h").isNull(), F.col("digest")).otherwise(F.xxhash64(*places.columns))
    cold = own.where(F.col("n") <= HOT).select(F.col("digest").alias("_d"), "owner")
    both = marked.join(cold, key == F.col("_d"), "left").withColumn("owner", F.when(F.col("_h").isNull(), F.col("owner")).otherwise(F.col("_f")))
    return both.where("owner IS NOT NULL").select(*places.columns, "owner")


def candidates(rows: DataFrame, min_words: int) -> DataFrame:
    """(_k, run, digests, words): the runs of neighbouring chunks whose staying copies are elsewhere, a row each; `run` is the first
    chunk."""
    places = rows.select("_k", F.posexplode(F.arrays_zip("digests", "words")).alias("chunk", "c"))
    places = places.select("_k", "chunk", F.col("c.digests").alias("digest"), F.col("c.words").alias("words"))
    own = places.where("words > 0").groupBy("digest").agg(F.min("_k").alias("owner"), F.max("_k").alias("_z"), F.count(F.lit(1)).alias("n"))
    own = stage(own.where("owner < _z").select("digest", "owner", "n"), "substring-repeated")
    others = _met(_among(places.where("words > 0"), own), own).where("_k > owner").drop("owner")
    found = others.unionByName(places.where("words < 0").withColumn("words", -F.col("words")))
    # a chunk inside a document that has it earlier is repeated in any case; the earlier one may be too
    lists = found.groupBy("_k").agg(F.collect_set(F.struct("chunk", "words", "digest")).alias("again"))

    def over(batches):
        for batch in batches:
            again = batch.column(1)
            size = again.value_lengths().to_numpy()
            flat = again.flatten()
            doc, chunk, words, digest = np.repeat(np.arange(len(size)), size), *(flat.field(k).to_numpy() for k in range(3))
            order = np.lexsort((chunk, doc))
            doc, chunk, words, digest = doc[order], chunk[order], words[order], digest[order]
            begins = np.ones(len(doc), bool)
            begins[1:] = (doc[1:] != doc[:-1]) | (chunk[1:] != chunk[:-1] + 1)
            first = np.flatnonzero(begins)
            if not len(first):
                continue
            long_ = np.add.reduceat(words, first) >= min_words
            inside, ends = long_[np.cumsum(begins) - 1], np.diff(np.append(first, len(doc)))[long_]
            offsets = pa.array(np.concatenate(([0], np.cumsum(ends))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[inside])) for x in (digest, words)]
            own = batch.column(0).to_numpy()[doc[first[long_]]]
            yield pa.record_batch([pa.array(own), pa.array(chunk[first[long_]]), *lists], ["_k", "run", "digests", "words"])

    return lists.mapInArrow(lean(over), "_k long, run int, digests array<long>, words array<int>")


def together(rows: DataFrame, runs: DataFrame, joined_words: int) -> DataFrame:
    """(_k, run, joined): of every run with some, its stretches (first, last chunk) that stand in another place too."""

    def over(batches):
        for batch in batches:
            found, counted, parts = batch.column(2), batch.column(3), []
            for i, (k, run) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                digest, first, last = stretches(found[i].values.to_numpy(), counted[i].values.to_numpy(), joined_words)
                parts.append((np.full(len(digest), k, np.int64), np.full(len(digest), run, np.int32), digest, (first + run).astype(np.int32), (last + run).astype(np.int32)))
            if parts:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*parts)], ["_k", "run", "digest", "first", "last"])

    inside = stage(runs.mapInArrow(lean(over), "_k long, run int, digest long, first int, last int"), "substring-stretches")
    every = rows.select("_k", F.explode("stretches").alias("digest"), F.lit(False).alias("twice"))
    every = every.unionByName(rows.where("size(doubled) > 0").select("_k", F.explode("doubled").alias("digest"), F.lit(True).alias("twice")))
    same = _among(every, stage(inside.select("digest").distinct(), "substring-wanted"))
    same = same.groupBy("digest").agg(F.min("_k").alias("owner"), F.max("_k").alias("z"), F.max("twice").alias("twice"), F.count(F.lit(1)).alias("n"))
    same = stage(same.where("owner < z OR twice").select("digest", "owner", "n"), "substring-same")
    return _met(inside, same).groupBy("_k", "run").agg(F.collect_set(F.struct("first", "last")).alias("joined"))


def repeated(docs: DataFrame, min_words: int = MIN_RUN_WORDS) -> DataFrame:
    """(_k, runs): of every document with some, the runs (first, last chunk, first digest) that repeat together."""
    joined_words = max(1, min(JOINED_WORDS, min_words))
    rows = stage(chunks(docs, joined_words), "substring-chunks")
    runs = stage(candidates(rows, min_words), "substring-candidates")
    both = runs.join(together(rows, runs, joined_words), ["_k", "run"]).select("_k", "run", "digests", "words", "joined")

    def over(batches):
        for batch in batches:
            keep, last = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.int32)
            for i, run in enumerate(batch.column(1).to_pylist()):
                sums = np.concatenate(([0], np.cumsum(batch.column(3)[i].values.to_numpy())))
                place = batch.column(4)[i].values
                a, z = (place.field(k).to_numpy() - run for k in range(2))
                order = np.argsort(a, kind="stable")
                a, z = a[order], np.maximum.accumulate(z[order])
                begins = np.append(True, a[1:] > z[:-1])  # unions of stretches with a common chunk
                at = np.flatnonzero(begins)
                ends = z[np.append(at[1:], len(a)) - 1]
                keep[i] = (sums[ends + 1] - sums[a[at]]).max() >= min_words
                last[i] = run + len(sums) - 2
            first = pc.list_element(batch.column(2), 0) if batch.num_rows else pa.array([], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(last), first], ["_k", "first", "last", "digest"]).filter(pa.array(keep))

    whole = both.mapInArrow(lean(over), "_k long, first int, last int, digest long")
    return whole.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("first", "last", "digest"))).alias("runs"))


_LONGS = pa.list_(pa.int64())
_SPANS = ArrayType(StructType().add("start", "long").add("end", "long"))


def cut_out(raw: bytes, runs: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the runs of chunks, and the byte spans that went. A run whose first digest isn't this text's belongs
    to another document with the same key, and is left alone."""
    ends = cuts(np.frombuffer(raw, np.uint8))
    gone = []
    for r in runs:
        if r["last"] < len(ends):
            a = int(ends[r["first"] - 1]) if r["first"] else 0
            if digests(raw[a : ends[r["first"]]], np.array([int(ends[r["first"]]) - a]))[0][0] == r["digest"]:
                gone.append((a, int(ends[r["last"]])))
    kept, last = [], 0
    for a, b in gone:
        kept.append(raw[last:a])
        last = b
    kept.append(raw[last:])
    return b"".join(kept), gone


def strip(docs: DataFrame, min_words: int = MIN_RUN_WORDS, spans: str | None = None) -> DataFrame:
    """All documents, with their repeated passages removed; `spans` names a column for the (start, end) byte spans that went."""
    cols = docs.columns
    field = docs.schema["text"]
    with scope():
        again = stage(repeated(docs, min_words), "substring-runs", keep=True).withColumnRenamed("_k", "_own")
    if again.agg(F.coalesce(F.sum(F.size("runs") + 1), F.lit(0))).first()[0] <= BROADCAST_RUNS:
        again = F.broadcast(again)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), _key())
    joined = rows.join(again, F.col("_k") == F.col("_own"), "left")
    joined = joined.select(*[F.col(f"_row.`{c}`").alias(f"c{k}") for k, c in enumerate(cols)], F.col("runs"))
    at = cols.index(field.name)

    def over(batches):
        for batch in batches:
            texts, gone = [], []
            for t, a in zip(batch.column(at), batch.column(len(cols))):
                t, a = t.as_py(), a.as_py()
                if not a or not t:
                    texts.append(t), gone.append([])
                    continue
                raw, cut = cut_out(t.encode(), a)
                texts.append(raw.decode()), gone.append([{"start": x, "end": y} for x, y in cut])
            columns = list(batch.columns[: len(cols)])
            columns[at] = pa.array(texts, columns[at].type)
            if spans:
                columns.append(pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.record_batch(columns, out_names)

    out_names = [f"c{k}" for k in range(len(cols))] + ["_spans"] * bool(spans)
    schema = joined.drop("runs").schema
    if spans:
        schema = schema.add("_spans", _SPANS)
    out = joined.mapInArrow(lean(over), schema)
    named = [F.col(f"c{k}").alias(c) for k, c in enumerate(cols)]
    return out.select(*named, *([F.col("_spans").alias(spans)] if spans else []))
