"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two transducers are compiled from the vocabulary file.

The splitter reads character classes and marks where pre-tokens start. Its states remember what kind of run is open and
how many of the last characters are still undecided (white space before a word, a contraction's letters), so it never
looks ahead. Texts are cut into chunks; for each chunk the map from every possible start state to its end state is built
for all chunks at once, the maps are composed by a parallel prefix scan, and then each chunk is read again from its now
known state to get the marks.

The counter reads the bytes of a pre-token. After each byte its state is the longest suffix that some longer
token starts with, with the last token and the relative token count at each position where one could start; that is all that the next
byte's tokenization can depend on, since the tokenization of a prefix ends in the one suffix token whose pair with the
token before it is stable. Transitions are annotated with the change of the token count, so a word's count is a sum along
its path. Pre-tokens stand where the splitter's scan has parted the text, so each begins in the one start state; one that is
longer than a chunk is read in chunks, whose maps (from start states to end state and count) are composed by a prefix scan again.
States are numbered and transitions filled in as they are first taken, in bounded tables.

Defined cases: null and empty texts have no tokens; the special string is one token wherever it stands, as the library's
default has it; repeated rows come out alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_codec import portions

CHUNK = 64
CACHE_WORDS = 600_000
MAX_STATES = 300_000

# Character classes of the split pattern. The contractions are 's 't 're 've 'm 'll 'd.
LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE, ONE, R, V, E, L, STOP = range(12)
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Splitter states. START: nothing is open. GAP: a lone space that may lead a word. In BLANK the run's last character
# is white space but no space; in BLANKS it is a space after others. Q, QR, QV, QL: an open quote and its first letter.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, GAP, BLANK, BLANKS, Q, QR, QV, QL, DONE = range(12)
# Marks of a transition: bit k says that a pre-token starts k characters before the one being read.
HERE, BACK1, BACK2 = 1, 2, 4


def split_table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks, by state and class."""
    letters = (LETTER, ONE, R, V, E, L)
    opened = {NUMBER: IN_NUMBERS, SPACE: GAP, WHITE: BLANK, OTHER: IN_OTHERS, QUOTE: Q, STOP: START} | dict.fromkeys(letters, IN_LETTERS)
    nxt, marks = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    for state in range(12):
        for c in range(12):
            to, mark = opened[c], HERE
            if state == IN_LETTERS and c in letters or state == IN_NUMBERS and c == NUMBER:
                mark = 0
            elif state == IN_OTHERS and c in (OTHER, QUOTE):
                to, mark = IN_OTHERS, 0
            elif state in (GAP, BLANK, BLANKS) and c in (SPACE, WHITE):
                to, mark = (BLANKS if c == SPACE else BLANK), 0
            elif state == GAP and c != STOP:  # the space leads what follows; a quote after it starts no contraction
                to, mark = (IN_OTHERS if c == QUOTE else to), 0
            elif state == BLANKS and c != STOP:
                to, mark = (IN_OTHERS if c == QUOTE else to), BACK1
            elif state == BLANK and c != STOP:  # the last of two or more is a pre-token of its own
                mark = HERE | BACK1
            elif state == Q:
                if c == ONE:
                    to, mark = DONE, 0
                elif c in (R, V, L):
                    to, mark = {R: QR, V: QV, L: QL}[c], 0
                elif c in (OTHER, QUOTE):
                    to, mark = IN_OTHERS, 0
            elif state in (QR, QV, QL):
                if c == (L if state == QL else E):
                    to, mark = DONE, 0
                elif c in letters:
                    to, mark = IN_LETTERS, BACK1
                else:
                    mark = HERE | BACK1
            nxt[state, c], marks[state, c] = to, mark
    return nxt, marks


def class_table() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    points = [chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000)]
    everything = "".join(points)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, everything):
            table[m.start() : m.end()] = c
    table[WHITE_SPACE] = WHITE
    table[0x20], table[ord("'")] = SPACE, QUOTE
    for c in "stmd":
        table[ord(c)] = ONE
    for c, k in (("r", R), ("v", V), ("e", E), ("l", L)):
        table[ord(c)] = k
    return table


class Splitter:
    def __init__(self):
        self.next, self.marks = split_table()
        self.classes = class_table()

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Positions where pre-tokens (or stops) start."""
        n = len(classes)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, STOP, np.uint8)
        grid[:n] = classes
        grid = grid.reshape(chunks, CHUNK)
        step = self.next.reshape(-1)
        # the map of every chunk, from all states at once
        at = np.tile(np.arange(12, dtype=np.uint8), (chunks, 1))
        for j in range(CHUNK):
            at = step[at.astype(np.int16) * 12 + grid[:, j : j + 1]]
        # prefix scan: after it, row i is the map of chunks 0..i
        hop = 1
        while hop < chunks:
            at[hop:] = np.take_along_axis(at[hop:], at[:-hop].astype(np.intp), 1)
            hop *= 2
        state = np.concatenate(([START], at[:-1, START])).astype(np.uint8)
        marks = np.empty((chunks, CHUNK), np.uint8)
        flat = self.marks.reshape(-1)
        for j in range(CHUNK):
            k = state.astype(np.int16) * 12 + grid[:, j]
            marks[:, j] = flat[k]
            state = step[k]
        marks = marks.reshape(-1)[:n]
        out = (marks & HERE) > 0
        out[:-1] |= (marks[1:] & BACK1) > 0
        return np.flatnonzero(out)


class Counter:
    """The byte transducer of one vocabulary."""

    def __init__(self, vocabulary: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        """merges: (left, right) -> (rank, result)."""
        self.merges = merges
        self.made = {result: (rank, pair) for pair, (rank, result) in sorted(merges.items(), key=lambda x: -x[1][0])}
        self.tokens = vocabulary
        self.prefixes = {token[:k] for token in vocabulary for k in range(len(token))}
        self.stable: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states = [(b"", ((-1, 0),))]
        self.number = {self.states[0]: 0}
        self.step: list[dict[int, tuple[int, int]]] = [{}]

    def is_stable(self, left: int, right: int) -> bool:
        """Whether these two stay as they are when their bytes are tokenized together."""
        key = (left, right)
        if key not in self.stable:
            self.stable[key] = self._is_stable(left, right)
        return self.stable[key]

    def _is_stable(self, left: int, right: int) -> bool:
        limit = 1 << 60
        while True:
            found = self.merges.get((left, right))
            if found is not None and found[0] < limit:
                return False  # the pair across the border would have merged first
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            # undo the later of the two merges; of equal ones the right one is later, as merges run from the left
            if b is None or a is not None and a[0] > b[0]:
                limit, left = a[0], a[1][1]
            else:
                limit, right = b[0] + 1, b[1][0]

    def advance(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change of the token count."""
        suffix, ends = self.states[state]  # ends[i]: last token and relative count when i bytes of the suffix are read
        grown = suffix + bytes([byte])
        for cut in range(len(grown)):
            token = self.tokens.get(grown[cut:])
            if token is not None and ends[cut] is not None and (ends[cut][0] < 0 or self.is_stable(ends[cut][0], token)):
                count = ends[cut][1] + 1
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        # what no longer token can continue from is forgotten, so that more states fall together
        ends = [(t, c - count) if grown[k:] in self.prefixes else None for k, (t, c) in enumerate([*(e or (0, 0) for e in ends), (token, count)])]
        keep = next(k for k, e in enumerate(ends) if e is not None)
        key = (grown[keep:], tuple(ends[keep:]))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
        return self.number[key], count

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """The state after some bytes and the sum of the transitions' counts."""
        total, step = 0, self.step
        for b in data:
            got = step[state].get(b)
            if got is None:
                got = step[state][b] = self.advance(state, b)
            state, change = got
            total += change
        return state, total

    def count(self, word: bytes) -> int:
        """Tokens of a pre-token. Of a long one every chunk gets its map from start states to (end state, count), for the state
        that the chunk before it leads to from the start; the maps are composed by a prefix scan, and a map that lacks a state
        which turns out to be reached is extended by it."""
        if len(self.states) > MAX_STATES:
            self.reset()
        if len(word) <= CHUNK:
            return self.run(0, word)[1]
        chunks = [word[a : a + CHUNK] for a in range(0, len(word), CHUNK)]
        starts = [0, *(self.run(0, c)[0] for c in chunks[:-1])]
        maps = [{s: self.run(s, c)} for s, c in zip(starts, chunks)]
        hop = 1
        while hop < len(chunks):
            for i in range(len(chunks) - 1, hop - 1, -1):
                composed = {}
                for s, (mid, n) in maps[i - hop].items():
                    end, more = maps[i].get(mid) or self.run(mid, b"".join(chunks[i - hop + 1 : i + 1]))
                    composed[s] = (end, n + more)
                maps[i] = composed
            hop *= 2
        return maps[-1][0][1]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins by which vocabulary files write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in plain):
        out[chr(256 + k)] = b
    return out


class TokenCounter:
    _made: dict = {}

    @classmethod
    def of(cls, path: str) -> TokenCounter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.special = [x["content"] for x in config["added_tokens"]]
        alphabet = byte_alphabet()
        vocab = config["model"]["vocab"]
        ids = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in config["model"]["merges"])
        self.counter = Counter(ids, {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)})
        self.splitter = Splitter()
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts; the texts are split as one string, with a stop between each two and for special strings."""
        parts, owner, out = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            pieces = [text]
            for special in self.special:
                pieces = [p for piece in pieces for p in piece.split(special)]
            out[k] = len(pieces) - 1
            parts += pieces
            owner += [k] * len(pieces)
        joined = "\0".join(parts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.splitter.classes[points]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes[ends] = STOP
        starts = self.splitter.starts(classes)
        stop = classes[starts] == STOP
        known, count = self.known, self.counter.count
        if len(known) > CACHE_WORDS:
            known.clear()
        bounds = starts.tolist()
        words = [joined[a:b] for a, b in zip(bounds, bounds[1:] + [len(joined)])]
        for w in set(words).difference(known):
            known[w] = count(w.encode())
        found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        found[stop] = 0
        np.add.at(out, np.array(owner)[np.searchsorted(ends, starts)], found)
        return out.tolist()


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""

    def over(batches):
        counter = TokenCounter.of(path)
        for batch in batches:
            sizes, counts = [], []
            for texts in portions(batch.column(1), 1 << 19):
                sizes += [len(t.encode()) for t in texts]
                counts += counter.counts(texts)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names)

    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    slim = docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text")
    return slim.mapInArrow(over, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
