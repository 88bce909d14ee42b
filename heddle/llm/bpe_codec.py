"""Byte-level BPE encoding and decoding by recursive DuckDB queries, run in each partition.

Encoding: a text's matches of the split pattern become rows (word, position, token), one per byte at first. A recursive
query joins each word's neighbouring tokens to the merge table and contracts the leftmost pair of least rank in every
unfinished word, until no word has a pair left. Decoding: token rows join the vocabulary and an ordered aggregate puts
their bytes together again.

Only words that a worker has not met lately go through the queries; a bounded table keeps the recent ones. Words above
`LONG_WORD` bytes go through the same recursion in batches of their own. There a round contracts all occurrences of a word's
least pair, from the left and without overlaps, where that is the same as one at a time: where no pair with the new token has a
lower rank, so none can come first before the last occurrence is gone. A query runs a bounded number of rounds, since a
recursion keeps the rows of all of them, and the next one goes on with its last rows.

Defined cases: null and empty texts have no tokens; bytes are whatever UTF-8 the text has; repeated rows and ties come out
alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LONG_WORD = 48
LONG_ROWS = 20_000  # bytes of long words in a batch, unless one alone has more
KEPT_ROWS = 1_500_000  # of all rounds of a query over long words
CACHE_WORDS = 600_000
BATCH_WORDS = 30_000
DUCKDB_MB = 300

# Rows are linked to the next position and its token; `pair` is rank and position of the row's pair in one number, so that
# its least value in a word is the leftmost pair of least rank. A word without pairs is in no further round.
ENCODE = f"""
WITH RECURSIVE st(round, word, pos, id, next_pos, next_id, pair) AS (
  SELECT 0, s.word, s.pos, s.id, s.next_pos, s.next_id, m.rank * {LONG_WORD + 1} + s.pos
  FROM (SELECT word, pos, id, lead(pos) OVER w AS next_pos, lead(id) OVER w AS next_id
        FROM start WINDOW w AS (PARTITION BY word ORDER BY pos)) s
  LEFT JOIN merges m ON m.pair = (s.id::BIGINT << 20) + s.next_id
  UNION ALL
  SELECT u.round, u.word, u.pos, u.id, u.next_pos, u.next_id,
         CASE WHEN u.touched THEN m.rank * {LONG_WORD + 1} + u.pos ELSE u.pair END
  FROM (
    SELECT s.round + 1 AS round, s.word, s.pos, s.pair,
           CASE WHEN s.pos = b.pos THEN b.rank ELSE s.id END AS id,
           CASE WHEN s.pos = b.pos THEN g.next_pos ELSE s.next_pos END AS next_pos,
           CASE WHEN s.pos = b.pos THEN g.next_id WHEN s.next_pos = b.pos THEN b.rank ELSE s.next_id END AS next_id,
           s.pos = b.pos OR coalesce(s.next_pos = b.pos, false) AS touched
    FROM st s
    JOIN (SELECT word, min(pair) % {LONG_WORD + 1} AS pos, (min(pair) // {LONG_WORD + 1})::INTEGER AS rank, arg_min(next_pos, pair) AS gone
          FROM st WHERE pair IS NOT NULL GROUP BY word) b ON s.word = b.word
    JOIN st g ON g.word = b.word AND g.pos = b.gone
    WHERE s.pos <> b.gone) u
  LEFT JOIN merges m ON u.touched AND m.pair = (u.id::BIGINT << 20) + u.next_id
)
SELECT st.word, string_agg(st.id::VARCHAR, ' ' ORDER BY st.pos) AS ids
FROM st JOIN (SELECT word, max(round) AS round FROM st GROUP BY word) f ON f.word = st.word AND f.round = st.round
GROUP BY st.word ORDER BY st.word
"""
# `n` numbers the neighbouring least pairs of a chain, of which every second one overlaps the one before.
ENCODE_LONG = """
WITH RECURSIVE st(round, word, pos, id) AS (
  SELECT 0, word, pos, id FROM start
  UNION ALL
  SELECT round + 1, word, pos, id FROM (
    SELECT round, word, pos, CASE WHEN merged THEN rank ELSE id END AS id, lag(merged, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone
    FROM (
      SELECT *, hit AND row_number() OVER (PARTITION BY word, hit, chain ORDER BY pos) % 2 = 1 AND (calm OR pos = first) AS merged
      FROM (
        SELECT *, nth - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS chain, min(pos) FILTER (hit) OVER (PARTITION BY word) AS first
        FROM (
          SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY word), false) AS hit, row_number() OVER (PARTITION BY word ORDER BY pos) AS nth
          FROM (SELECT *, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next_id FROM st) s
          LEFT JOIN merges m ON m.pair = (s.id::BIGINT << 20) + s.next_id)))
    WHERE first IS NOT NULL)
  WHERE NOT gone AND round < $rounds)
SELECT st.round, st.word, st.pos, st.id
FROM st JOIN (SELECT word, max(round) AS round FROM st GROUP BY word) f ON f.word = st.word AND f.round = st.round
ORDER BY st.word, st.pos
"""
DECODE = """
SELECT c.seq, string_agg(v.hex, '' ORDER BY c.pos) AS hex FROM coded c JOIN vocabulary v ON v.id = c.id GROUP BY c.seq ORDER BY c.seq
"""


class Codec:
    """Encodes and decodes by a rank file; lives in one worker process."""

    _made: dict = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.find = regex.compile(pattern).findall
        self.find_latin, self.beyond = self._latin(pattern), re.compile("[^\x00-ɏ]").search
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCKDB_MB}MB"})
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        left, right, rank = np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32)
        least = np.full(max(self.pieces) + 1, 1 << 30)  # rank of a pair with the token
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        self._table("merges", pair=(left << 20) + right, rank=rank, calm=least[rank] > rank)
        self._table("vocabulary", id=np.array(list(self.pieces), np.int32), hex=[p.hex() for p in self.pieces.values()])
        self.ids: dict[str, str] = {}
        self.bytes: dict[str, bytes] = {}

    @staticmethod
    def _latin(pattern: str):
        """The same pattern with its classes written out, for texts without characters beyond U+024F; None where it uses
        others than letters, numbers and white space."""
        import regex

        def span(kind):
            return "".join(re.escape(chr(c)) for c in range(0x250) if regex.match(kind, chr(c)))

        letters, numbers, white = span(r"\p{L}"), span(r"\p{N}"), r"\x09-\x0d \x85\xa0"
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{letters}{numbers}]")
        plain = plain.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]")
        return None if re.search(r"\\[pPwWdDbB]", plain) else re.compile(plain).findall

    def split(self, text: str) -> list[str]:
        if self.find_latin is not None and (text.isascii() or not self.beyond(text)):
            return self.find_latin(text)
        return self.find(text)

    def _table(self, name: str, **columns) -> None:
        self.db.register("source", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM source")
        self.db.unregister("source")

    def _query(self, sql: str, name: str, given: dict | None = None, **columns):
        self.db.register(name, pa.table(columns))
        try:
            return self.db.execute(sql, given).fetchall() if given is None else self.db.execute(sql, given).fetchnumpy()
        finally:
            self.db.unregister(name)

    def encode_words(self, words: list[str]) -> list[str]:
        """Ids of each word in decimal, joined by a space."""
        raw = [w.encode() for w in words]
        out: list[str] = [""] * len(raw)
        short = [i for i, b in enumerate(raw) if len(b) <= LONG_WORD]
        part, size = [], 0
        for i, b in enumerate(raw):
            if len(b) > LONG_WORD:
                if size + len(b) > LONG_ROWS and part:
                    self._encode_long(raw, part, out)
                    part, size = [], 0
                part.append(i)
                size += len(b)
        if part:
            self._encode_long(raw, part, out)
        for a in range(0, len(short), BATCH_WORDS):
            part = short[a : a + BATCH_WORDS]
            data = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)
            size = np.array([len(raw[i]) for i in part])
            word = np.repeat(np.arange(len(part), dtype=np.int32), size)
            pos = (np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            for k, ids in self._query(ENCODE, "start", word=word, pos=pos, id=self.byte_id[data]):
                out[part[k]] = ids
        return out

    def _encode_long(self, raw: list[bytes], part: list[int], out: list[str]) -> None:
        size = np.array([len(raw[i]) for i in part])
        word, pos = np.repeat(np.array(part, np.int32), size), (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        ids = self.byte_id[np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)]
        while len(word):
            rounds = max(2, KEPT_ROWS // len(word))
            rows = self._query(ENCODE_LONG, "start", {"rounds": rounds}, word=word, pos=pos, id=ids)
            word, pos, ids = (np.asarray(rows[c], np.int32) for c in ("word", "pos", "id"))
            open_ = np.asarray(rows["round"]) == rounds
            done, at = np.unique(word[~open_], return_index=True)
            for i, some in zip(done.tolist(), np.split(ids[~open_], at[1:])):
                out[i] = " ".join(map(str, some.tolist()))
            word, pos, ids = word[open_], pos[open_], ids[open_]

    def decode_sequences(self, sequences: list[str]) -> list[bytes]:
        """Bytes of each sequence of decimal ids."""
        out = []
        for a in range(0, len(sequences), BATCH_WORDS):
            part = sequences[a : a + BATCH_WORDS]
            size = np.fromiter((s.count(" ") + 1 for s in part), np.int64, len(part))
            ids = np.fromstring(" ".join(part), np.int32, sep=" ")
            rows = self._query(DECODE, "coded", seq=np.repeat(np.arange(len(part), dtype=np.int32), size), pos=np.arange(len(ids), dtype=np.int32), id=ids)
            out += [bytes.fromhex(h) for _, h in rows]
        return out

    def encode(self, texts: list[str]) -> list[list[str]]:
        """Of each text, the id sequences of its words, in order."""
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.ids) if split else set()
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids = {}
            new = set().union(*split)
        if new:
            words = list(new)
            self.ids.update(zip(words, self.encode_words(words)))
        known = self.ids.__getitem__
        return [list(map(known, words)) for words in split]

    def decode(self, coded: list[list[str]]) -> list[bytes]:
        """The bytes that the id sequences stand for, put together text by text."""
        new = set().union(*coded).difference(self.bytes) if coded else set()
        if len(self.bytes) + len(new) > CACHE_WORDS:
            self.bytes = {}
            new = set().union(*coded)
        if new:
            sequences = list(new)
            self.bytes.update(zip(sequences, self.decode_sequences(sequences)))
        known = self.bytes.__getitem__
        return [b"".join(map(known, sequences)) for sequences in coded]


def portions(texts: pa.Array, most: int = 2_000_000) -> Iterator[list[str]]:
    """The column's texts (null: empty) in lists of about `most` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""

    def over(batches):
        codec = Codec.of(path, pattern)
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for texts in portions(batch.column(1)):
                coded = codec.encode(texts)
                for sequences, data in zip(coded, codec.decode(coded)):
                    joined = " ".join(sequences).encode()
                    count.append(joined.count(b" ") + bool(joined))
                    ids_sha.append(hashlib.sha256(joined).hexdigest())
                    text_sha.append(hashlib.sha256(data).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    slim = docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text")
    return slim.mapInArrow(over, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>)."""

    def over(batches):
        codec = Codec.of(path, pattern)
        for batch in batches:
            ids = [[int(i) for s in doc for i in s.split(" ")] for texts in portions(batch.column(1)) for doc in codec.encode(texts)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text").mapInArrow(over, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); an id that the vocabulary lacks raises."""

    def over(batches):
        codec = Codec.of(path, pattern)
        for batch in batches:
            ids = [" ".join(map(str, x or [])) for x in batch.column(1).to_pylist()]
            some = iter(codec.decode_sequences([s for s in ids if s]))
            data = [next(some) if s else b"" for s in ids]
            for s, d in zip(ids, data):
                if sum(len(codec.pieces[int(i)]) for i in s.split()) != len(d):
                    raise ValueError("an id is not in the vocabulary")
            yield pa.record_batch([batch.column(0), pa.array([d.decode("utf-8", "replace") for d in data], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(over, "doc_id long, text string")
