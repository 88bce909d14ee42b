"""Exact dedup with two Bloom passes; DataFrame functions only.

Pass 1 counts the documents at two hashed bit positions each; the positions that were hit twice or more form two bit
maps. Pass 2 tests each document's digest against both bit maps: if either bit is clear, no other document can be equal
to it, and the row passes straight through as a group of its own. Only the possibly repeated digests are shuffled,
grouped and joined. A false positive costs one shuffled row and changes no result.

The bit maps hold at most `MAX_BITS` bits each (16 MB), which is what a broadcast is bounded by. Inputs with more than
MAX_BITS / BITS_PER_ROW documents are worked on in ranges of the digest, each with both passes and maps of its own; the staged
digests are sorted inside their files, so that a range reads its own row groups only and all ranges together read the table
about once. Pass 1 shuffles counts of positions, some ten bytes a document; whole bit maps from every task would be more as long
as a task has fewer documents than a map has bytes.

`dedup` returns whole rows. It tests them against maps of the digests that are known to repeat, and joins those that pass with
their group's staying id: by broadcast while there are at most `BROADCAST_ROWS` of these, so that no text moves, and beyond that
by a shuffle of the texts that pass. With some 100 million different repeated texts these maps, which stay bounded, let most
texts pass.

Defined cases: a null text equals the empty text; null doc_ids sort below all others, so a row with an id stays in their
favour; rows that repeat the same (doc_id, text) form one group with that keep_id, and each of them is marked `kept`
(`dedup` keeps one); an empty table gives an empty result; extra columns are not read, and `dedup` returns all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, owners, salt_of, scope, stage

BITS_PER_ROW = 8
MAX_BITS = 1 << 27
MIN_BITS = 1 << 16
MAP_BITS = 32768  # of one bucket of the bitmap functions
BROADCAST_ROWS = 200_000  # of about 120 bytes


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(fold_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def map_bits(n_keys: int) -> int:
    """Bits of each map for so many keys: a power of two, MAX_BITS at most."""
    bits = MIN_BITS
    while bits < min(MAX_BITS, n_keys * BITS_PER_ROW):
        bits *= 2
    return bits


def digest_ranges(n_rows: int) -> list[tuple[str, str]]:
    """Bounds (from, below) of as many equal ranges of hexadecimal digests as keep each one's maps bounded."""
    n = max(1, -(-n_rows * BITS_PER_ROW // MAX_BITS))
    cuts = [format(k * (1 << 60) // n, "015x") for k in range(n)]
    return list(zip(cuts, [*cuts[1:], "g"]))


def _position(key: str, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(bits))


def bit_maps(keys: DataFrame, key: str, bits: int, least: int = 1) -> list[DataFrame]:
    """Two bit maps, as rows of `MAP_BITS` bits, of the positions that `least` rows of `keys` or more have."""
    out = []
    for seed in (1, 2):
        at = f"_p{seed}"
        hit = keys.select(_position(key, seed, bits).alias(at)).groupBy(at).count().where(F.col("count") >= least)
        # the bitmap functions count positions from 1
        out.append(
            hit.groupBy(F.bitmap_bucket_number(F.col(at) + 1).alias(f"_b{seed}")).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position(F.col(at) + 1)).alias(f"_m{seed}")
            )
        )
    return out


def in_maps(rows: DataFrame, maps: list[DataFrame], key: str, bits: int) -> DataFrame:
    """`rows` with a boolean column `maybe`: whether both bits of the key are set."""
    tests = []
    for seed, some in zip((1, 2), maps):
        at = _position(key, seed, bits) + 1
        # at most MAX_BITS / 8 bytes are broadcast
        rows = rows.withColumn(f"_b{seed}", F.bitmap_bucket_number(at)).join(F.broadcast(some), f"_b{seed}", "left")
        bit = F.bitmap_bit_position(at).cast("int")
        byte = F.hex(F.substring(F.col(f"_m{seed}"), F.shiftright(bit, 3) + 1, F.lit(1)))
        # of the byte's two hexadecimal digits the one that holds the bit
        digit = F.ascii(F.substring(byte, 2 - F.shiftright(bit.bitwiseAND(7), 2), F.lit(1)))
        value = digit - F.when(digit >= 65, 55).otherwise(48)
        tests.append(F.coalesce(F.getbit(value, bit.bitwiseAND(3)) == 1, F.lit(False)))
    return rows.withColumn("maybe", tests[0] & tests[1]).drop("_b1", "_b2", "_m1", "_m2")


def possibly_repeated(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, a staged table, with a boolean column `maybe`: false proves that only one row has this hexadecimal key."""
    n = rows.count()
    bounds = digest_ranges(n)
    bits = map_bits(-(-n // len(bounds)))
    parts = []
    for low, high in bounds:
        part = rows.where((F.col(key) >= low) & (F.col(key) < high))
        parts.append(stage(in_maps(part, bit_maps(part, key, bits, 2), key, bits), "exact-tested", keep=True))
    return rows.sparkSession.read.schema(parts[0].schema).parquet(*[p.staged_path for p in parts])


def _rank() -> Column:
    """The least of these has the largest doc_id; null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("neg"))


def _tested(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, maybe) of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("text_sha256"))
    with scope():
        return possibly_repeated(stage(slim.sortWithinPartitions("text_sha256"), "exact-keys"), "text_sha256")


def _owners(maybe: DataFrame) -> DataFrame:
    """(_k, _s, size, _keep): digest, salt, documents and staying doc_id of every group of two or more, a row for each salt."""
    own = owners(maybe.select("text_sha256", "_rank"), "text_sha256", ["_rank"])
    return own.select(F.col("text_sha256").alias("_k"), F.col("salt").alias("_s"), "size", (-F.col("first._rank.neg")).alias("_keep"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document."""
    slim = _tested(docs)
    alone = slim.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = slim.where("maybe").withColumn("_rank", _rank())
    found = maybe.withColumn("_salt", salt_of(["_rank"])).join(
        _owners(maybe), (F.col("text_sha256") == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left"
    )
    many = F.col("size").isNotNull()
    keep = F.when(many, F.col("_keep")).otherwise(F.col("doc_id"))
    return alone.unionByName(
        found.select(
            "doc_id",
            keep.alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(keep).alias("kept"),
            "text_sha256",
        )
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row with the largest doc_id, once.

    Texts whose digest isn't among the repeated ones are neither shuffled nor joined.
    """
    with scope():
        tested = _tested(docs).where("maybe").withColumn("_rank", _rank())
        own = stage(_owners(tested), "exact-owners")
        # groups in which several rows have the staying id
        best = tested.withColumn("_salt", salt_of(["_rank"])).join(own, (F.col("text_sha256") == F.col("_k")) & (F.col("_salt") == F.col("_s")))
        ties = best.where(F.col("doc_id").eqNullSafe(F.col("_keep"))).groupBy("_k").count().where("count > 1").select("_k", F.lit(True).alias("_tie"))
        own = stage(own.drop("size").join(ties, "_k", "left"), "exact-owners", keep=True)
    again = own.select(F.col("_k").alias("_sha")).distinct()
    bits = map_bits(again.count())
    few = own.count() <= BROADCAST_ROWS
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*cols).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("_sha"))
    rows = in_maps(rows, bit_maps(again, "_sha", bits), "_sha", bits)
    found = (
        rows.where("maybe")
        .withColumn("_rank", _rank())
        .withColumn("_salt", salt_of(["_rank"]))
        .join(F.broadcast(own) if few else own, (F.col("_sha") == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left")
    )
    winner = F.col("_k").isNotNull() & F.col("doc_id").eqNullSafe(F.col("_keep"))
    alone = found.where(F.col("_k").isNull() | (winner & F.col("_tie").isNull())).select("_row.*")
    tied = found.where(winner & F.col("_tie")).groupBy("_sha").agg(F.first("_row").alias("_row")).select("_row.*")
    return rows.where(~F.col("maybe")).select("_row.*").unionByName(alone).unionByName(tied)
