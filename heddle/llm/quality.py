"""Quality rules by distribution divergence.

A document is reduced to two histograms: shares of character classes, and shares of a language's common words among all
words. Each language's reference is the mean histogram of the documents that the same counts place in that language; it
is taken over all documents, and then once more over those near the first one, so that junk doesn't shape it. A
document is rejected when the Jensen-Shannon distance (base 2, 0 to 1) of either histogram to its language's reference
exceeds a limit. The word histogram of a short text is mostly noise, so it only counts from `MIN_WORDS` words on; and
texts of under 50 words, or made of repeated windows, fail before any distance is looked at.

Defined cases: a null text has no words, counts as zero everywhere, and is rejected like an empty one; a text without any
common word counts as the first language's; repeated rows get equal verdicts; an empty table gives an
empty result; `accept` returns the kept rows with every column they had.
"""

from __future__ import annotations

import re
from collections import Counter as Count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import lean, stage

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
BASE_WORDS = 50
MIN_WORDS = 150
CLASS_LIMIT = 0.25
WORD_LIMIT = 0.32
NEAR = 0.20  # documents that shape the second reference
COMMON = {
    "en": "the of and to a in is that it on for was with as be this by at are from an or".split(),
    "fr": "de la le et les des en un du que une est pour qui dans au par sur pas avec plus".split(),
    "de": "der die und in den von zu das mit sich des für auf im nicht ist dem eine ein als".split(),
    "es": "de la que el en y los se del por las un con no una su para es al lo como".split(),
}
LANGS = list(COMMON)
CLASSES = ["lower", "upper", "non_ascii", "digit", "space", "line", "sentence", "symbol"]
_WIDTH = 1 + max(map(len, COMMON.values()))
_WORD_AT: dict[str, list[tuple[int, int]]] = {}
for _l, _words in enumerate(COMMON.values()):
    for _k, _w in enumerate(_words):
        _WORD_AT.setdefault(_w, []).append((_l, _k + 1))


def _class_matrix() -> np.ndarray:
    out = np.zeros((256, len(CLASSES)), np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            k = "non_ascii" if b >= 0xC0 else None  # one lead byte a character
        elif "a" <= c <= "z":
            k = "lower"
        elif "A" <= c <= "Z":
            k = "upper"
        elif c.isdigit():
            k = "digit"
        elif c == "\n":
            k = "line"
        elif c <= " ":
            k = "space"
        else:
            k = "sentence" if c in ".,;:?'\"-()" else "symbol"
        if k:
            out[b, CLASSES.index(k)] = 1
    return out


_CLASS = _class_matrix()


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, len(windows))
    if len(number) == len(windows):
        return 0
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int, np.ndarray, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, language, common-word counts."""
    words = WORDS.findall(text)
    classes = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256) @ _CLASS
    lines = [x for x in text.split("\n") if WORDS.search(x)] if "\n" in text else []
    hits = np.zeros((len(LANGS), _WIDTH), np.int64)
    for w, n in Count(words).items():
        if len(w) <= 8:
            for lang, k in _WORD_AT.get(w.lower().rstrip(".,;:!?"), ()):
                hits[lang, k] += n
    lang = int(hits.sum(1).argmax())
    hist = hits[lang]
    hist[0] = len(words) - hist.sum()
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), classes, lang, hist


def shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(-1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance, base 2."""
    m = (p + q) / 2

    def kl(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(-1)

    return np.sqrt(np.maximum((kl(p) + kl(q)) / 2, 0))


_NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_FEATURES = f"doc_id long, {', '.join(f'{c} long' for c in _NUMBERS)}, language int, classes array<long>, common array<long>"


def features(docs: DataFrame) -> DataFrame:
    """The counts of every document, whole texts."""

    def over(batches):
        for batch in batches:
            rows = [measure(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            columns += [pa.array([r[6] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.list_(pa.int64())), pa.array([r[7] for r in rows], pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), *columns], names)

    names = ["doc_id", *_NUMBERS, "language", "classes", "common"]
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text").mapInArrow(lean(over), _FEATURES)


def failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < BASE_WORDS) | (100 * n_repeat > 50 * n_words)


def distances(language, classes, common, refs) -> tuple[np.ndarray, np.ndarray]:
    c, w = shares(np.asarray(classes, float)), shares(np.asarray(common, float))
    return js_distance(c, refs[0][language]), js_distance(w, refs[1][language])


def references(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean class and common-word shares of each language, over all counted documents that pass the base rules.

    What reaches the driver is one row a language, whatever the input.
    """
    refs = None
    for _ in range(2):
        rows = counted.where(f"n_words >= {BASE_WORDS} AND 100 * n_repeat_words <= 50 * n_words")
        if refs is not None:
            rows = rows.where(_within(refs))
        sums = [F.avg(F.col("classes")[k] / F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)).alias(f"c{k}") for k in range(len(CLASSES))]
        sums += [F.avg(F.col("common")[k] / F.col("n_words")).alias(f"w{k}") for k in range(_WIDTH)]
        found = {r["language"]: r for r in rows.groupBy("language").agg(*sums).collect()}
        old = refs
        refs = (np.zeros((len(LANGS), len(CLASSES))), np.zeros((len(LANGS), _WIDTH)))
        for lang in range(len(LANGS)):
            if lang in found:
                refs[0][lang] = [found[lang][f"c{k}"] for k in range(len(CLASSES))]
                refs[1][lang] = [found[lang][f"w{k}"] for k in range(_WIDTH)]
            elif old is not None:
                refs[0][lang], refs[1][lang] = old[0][lang], old[1][lang]
    return refs


def _within(refs):
    """Class distance to the reference below NEAR, as a Column."""
    out = None
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)
    for lang in range(len(LANGS)):
        parts = []
        for k in range(len(CLASSES)):
            p, q = F.col("classes")[k] / total, F.lit(float(refs[0][lang][k]))
            m = (p + q) / 2
            parts.append(F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0))
        near = sum(parts[1:], parts[0]) / 2 < NEAR * NEAR
        out = F.when(F.col("language") == lang, near) if out is None else out.when(F.col("language") == lang, near)
    return out


def kept(n_words, n_repeat, language, classes, common, refs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept, and the two distances."""
    base = failed(n_words, n_repeat)
    by_class, by_word = distances(language, classes, common, refs)
    return base, ~base & (by_class <= CLASS_LIMIT) & ((n_words < MIN_WORDS) | (by_word <= WORD_LIMIT)), by_class, by_word


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distances), a row a document."""
    counted = stage(features(docs), "quality-counts")
    refs = references(counted)

    def over(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n = batch.num_rows
            classes = c["classes"].flatten().to_numpy().reshape(n, -1)
            common = c["common"].flatten().to_numpy().reshape(n, -1)
            got = kept(c["n_words"].to_numpy(), c["n_repeat_words"].to_numpy(), c["language"].to_numpy(), classes, common, refs)
            yield pa.record_batch([*(c[x] for x in ("doc_id", *_NUMBERS)), *map(pa.array, got)], names)

    names = ["doc_id", *_NUMBERS, "base_failed", "kept", "class_distance", "word_distance"]
    schema = f"doc_id long, {', '.join(f'{c} long' for c in _NUMBERS)}, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return counted.mapInArrow(lean(over), schema)


def accept(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Texts are measured once: the counts are staged beside them."""
    cols = docs.columns
    at = cols.index("text")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(cols)])
    own = plain.columns
    names = [*own, "n_words", "n_repeat_words", "language", "classes", "common"]

    def over(batches):
        for batch in batches:
            rows = [measure(t.as_py() or "") for t in batch.column(at)]
            counts = [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.int64()), (4, pa.int64()), (6, pa.int32()), (5, pa.list_(pa.int64())), (7, pa.list_(pa.int64())))]
            yield pa.record_batch([*batch.columns, *counts], names)

    schema = StructType(plain.schema.fields[:])  # add changes it in place
    for name, kind in (("n_words", LongType()), ("n_repeat_words", LongType()), ("language", IntegerType()), ("classes", ArrayType(LongType())), ("common", ArrayType(LongType()))):
        schema = schema.add(name, kind)
    counted = stage(plain.mapInArrow(lean(over), schema), "quality-counted", keep=True)
    refs = references(counted)

    def judged(batches):
        for batch in batches:
            c = {x: batch.column(names.index(x)) for x in names[len(cols) :]}
            n = batch.num_rows
            classes, common = (c[x].flatten().to_numpy().reshape(n, -1) for x in ("classes", "common"))
            keep = kept(c["n_words"].to_numpy(), c["n_repeat_words"].to_numpy(), c["language"].to_numpy(), classes, common, refs)[1]
            yield batch.select(own).filter(pa.array(keep, pa.bool_()))

    out = counted.mapInArrow(lean(judged), plain.schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(cols)])
