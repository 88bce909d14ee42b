"""Toxicity scores after noisy-channel deobfuscation.

Words written in leetspeak, with letters spaced out or repeated, are restored before they are scored. An observed token is
a lattice: each character offers its own letter, the letters that it stands for in leetspeak, or nothing (a separator, or
the repetition of the letter before it), each at a channel cost. Viterbi decoding finds the path of least total cost under
a character trigram model, whose counts are gathered from all words of all documents. What is decoded: tokens with other signs
than letters, alphabetic tokens with two equal letters side by side, and runs of three or more single characters, as one token.
All other tokens have one path only. A token that is decoded counts as written, too.

The classifier is a logistic regression on whether a text has certain words or word beginnings (4 to 6 letters), raw or
restored. They are chosen, by chi-square, and weighed on labelled rows outside the held-out fold, of which at most
`LABELLED` are used, those with the least hash of doc_id, each with one text.

Defined cases: null and empty texts score the model's prior; without labels of both kinds every score is the share of
toxic ones, smoothed; repeated doc_ids get a row each; a label that is null is not used; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

LABELLED = 12_000  # the bound of the labelled sample
FEATURES = 600
MIN_DOCS = 6
CACHE_TOKENS = 200_000
PREFIXES = (4, 5, 6)
# Which letters a sign stands for; fixed values of common leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
TRAIL = ".,;:!?\"'()[]{}*$%&#|<>+=~`^_-/\\…»«"
LEAD = ".,;:?\"'[]{}*%&#<>=~`^_-/\\…»«"
LEET_COST, DROP_COST, LEET_DROP_COST, REPEAT_COST, FIRST_REPEAT_COST = 1.5, 1.0, 6.0, 0.2, 4.0
LETTERS = 28  # 0: outside a word, 1-26: a-z, 27: any other letter
SPACED = re.compile(r"(?<!\S)\S(?:[ \t.\-_*]{1,2}[^\s.\-_*]){2,}(?!\S)")
DOUBLE = re.compile(r"\S*([^\W\d_])\1\S*")


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def _byte_classes() -> np.ndarray:
    """0 outside, 1-26 letters, 27 the lead byte of other characters, 255 what belongs to the character before."""
    out = np.zeros(256, np.uint8)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    out[0xC3:0xE0] = 27
    out[0x80:0xC0] = 255
    return out


_CLASS = _byte_classes()


def trigram_counts(raw: bytes) -> np.ndarray:
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    c = np.concatenate((np.zeros(2, np.int64), c[c != 255].astype(np.int64), np.zeros(1, np.int64)))
    grams = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
    # after the end of a word comes a fresh start
    grams = np.where(c[1:-1] == 0, c[2:], grams)
    return np.bincount(grams, minlength=LETTERS**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative logs) of a character after two others, smoothed; counted over all documents."""

    def over(batches):
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += trigram_counts((t.as_py() or "").encode())
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["gram", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(over, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(LETTERS**3)
    for r in rows.collect():  # LETTERS ** 3 rows at most
        counts[r["gram"]] = r["n"]
    tri = counts.reshape(LETTERS, LETTERS, LETTERS)
    uni = tri.sum((0, 1)) + 1
    uni = uni / uni.sum()
    bi = (tri.sum(0) + 5 * uni) / (tri.sum((0, 2)) + 5)[:, None]
    return -np.log((tri + 5 * bi) / (tri.sum(2, keepdims=True) + 5))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Of each character, what it may stand for ('' for nothing) and the channel's cost."""
    out = []
    run = 0
    for k, c in enumerate(token):
        run = run + 1 if k and token[k - 1] == c else 0
        if c.isalpha():
            arcs = [(c, 0.0)]
            if run:
                arcs.append(("", FIRST_REPEAT_COST if run == 1 and (k + 1 == len(token) or token[k + 1] != c) else REPEAT_COST))
        else:
            arcs = [(x, LEET_COST) for x in LEET.get(c, "")]
            arcs.append(("", DROP_COST if c not in LEET or run else LEET_DROP_COST))
        out.append(arcs)
    return out


def restore(token: str, costs: list) -> str:
    """The likeliest word behind an observed token."""
    best = {(0, 0): (0.0, "")}
    for arcs in lattice(token):
        step: dict = {}
        for (a, b), (cost, word) in best.items():
            for out, channel in arcs:
                if out:
                    x = letter(out)
                    state, total = (b, x), cost + channel + costs[a][b][x]
                else:
                    state, total = (a, b), cost + channel
                if state not in step or total < step[state][0]:
                    step[state] = (total, word + out)
        best = step
    return min((cost + costs[a][b][0], word) for (a, b), (cost, word) in best.items())[1]


class Reader:
    """The words of a text, raw and restored; lives in one task."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.known: dict[str, str] = {}

    def restored(self, token: str) -> str:
        word = self.known.get(token)
        if word is None:
            if len(self.known) > CACHE_TOKENS:
                self.known.clear()
            word = self.known[token] = restore(token, self.costs)
        return word

    def words(self, text: str) -> set[str]:
        low = text.lower()
        out, odd = set(), set()
        for token in set(low.split()):
            word = token.rstrip(TRAIL).lstrip(LEAD)
            if word.isalpha():
                out.add(word)
            elif word and not word.isdigit():
                odd.add(word)
        odd.update(m.group().rstrip(TRAIL).lstrip(LEAD) for m in DOUBLE.finditer(" ".join(out)))
        if sum(len(t) == 1 for t in out) + len(odd) > 1:
            odd.update(re.sub(r"[\s.\-_*]+", "", m.group()) for m in SPACED.finditer(low))
        for token in odd:
            if any(c.isalpha() for c in token):
                out.update(re.findall(r"[^\W\d_]+", token))
            out.add(self.restored(token))
        out.discard("")
        return out


def traits(words: set[str]) -> set[str]:
    """What a feature may be: `word$` or a beginning."""
    out = {w + "$" for w in words}
    for n in PREFIXES:
        out |= {w[:n] for w in words if len(w) >= n}
    return out


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.bias = bias
        self.whole = {k[:-1]: v for k, v in weights.items() if k.endswith("$")}
        self.start = {n: {k: v for k, v in weights.items() if len(k) == n and not k.endswith("$")} for n in PREFIXES}

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(self.whole[w] for w in self.whole.keys() & words)
        for n, known in self.start.items():
            if known:
                z += sum(known[p] for p in known.keys() & {w[:n] for w in words})
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def in_fold() -> F.Column:
    """Whether a row is held out: crc32 of its doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, costs: np.ndarray) -> Model:
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~in_fold())
    sample = usable.groupBy(F.col("doc_id").alias("_d")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = sample.orderBy(F.xxhash64("_d"), "_d").limit(LABELLED)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_d"))
    # an id may be repeated any number of times
    one = rows.groupBy("_d").agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).alias("t"), F.first("toxic").alias("toxic"))
    rows = stage(one.select("t.text", "toxic"), "toxic-sample")
    kinds = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = kinds.get(1, 0), kinds.get(0, 0)
    if not bad or not good:
        return Model({}, math.log((bad + 0.5) / (good + 0.5)))

    def count(batches):
        reader = Reader(costs)
        found: dict[str, list[int]] = {}
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1)):
                for f in traits(reader.words(t.as_py() or "")):
                    found.setdefault(f, [0, 0])[y.as_py()] += 1
        yield pa.record_batch([pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], ["f", "good", "bad"])

    seen = rows.mapInArrow(count, "f string, good long, bad long").groupBy("f").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    n = bad + good
    cross = F.col("bad") * (good - F.col("good")) - F.col("good") * (bad - F.col("bad"))
    total = F.col("bad") + F.col("good")
    chi = cross.cast("double") * cross * n / (total * (n - total) * bad * good)
    top = seen.where((total >= MIN_DOCS) & (total < n) & (cross > 0)).orderBy(chi.desc(), "f").limit(FEATURES).collect()
    names = {r["f"]: k for k, r in enumerate(top)}

    def hits(batches):
        reader = Reader(costs)
        for batch in batches:
            got = [sorted(names[f] for f in names.keys() & traits(reader.words(t.as_py() or ""))) for t in batch.column(0)]
            yield pa.record_batch([pa.array(got, pa.list_(pa.int32())), batch.column(1)], ["on", "toxic"])

    sampled = rows.mapInArrow(hits, "on array<int>, toxic int").collect()  # LABELLED rows at most, of FEATURES numbers at most
    x = np.zeros((len(sampled), len(names) + 1))
    x[:, -1] = 1
    for k, r in enumerate(sampled):
        x[k, r["on"]] = 1
    y = np.array([r["toxic"] for r in sampled], float)
    w = np.zeros(x.shape[1])
    moved, square = np.zeros_like(w), np.full_like(w, 1e-8)
    for _ in range(400):  # Adagrad on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y)
        grad[:-1] += 1e-4 * w[:-1]
        square += grad**2
        moved = 0.3 * grad / np.sqrt(square)
        w -= moved
    return Model({f: float(w[k]) for f, k in names.items()}, float(w[-1]))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    costs = language_model(docs)
    model = train(docs, labels, costs)

    def over(batches):
        reader = Reader(costs)
        for batch in batches:
            got = [model.score(reader.words(t.as_py() or "")) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold().alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(over, "doc_id long, held_out boolean, score double, predicted int")
