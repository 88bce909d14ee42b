"""The registered queries over the whole small tables, against the public libraries or a plain reading of the same rules."""

import base64
import collections
import hashlib
import html
import re
import zlib

import public_tokenizers as P
import pytest

from heddle.llm import queries
from tests.conftest import SF
from tests.llm.test_tokens import check_packing


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


def test_op1(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = []
    for d in docs:
        ids = encode(d.text or "")
        want.append((d.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, run(spark, "op1_bpe_codec"))) == sorted(want)


def test_op2(spark, docs):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = run(spark, "op2_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(d.doc_id for d in docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    clean = [r.predicted for r in got if labels.get(r.doc_id) == 0]
    assert clean and sum(clean) / len(clean) < 0.05


BLOCK = r"(?i)</?(?:p|div|h[1-6]|ul|ol|li|table|tr|td|th|blockquote|pre|section|header|footer|figure|figcaption|aside|nav)\b[^>]*>|\0"


def article(page):
    """The blocks of the one article element, without comments, scripts and elements that are named as something else."""
    page = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", page)
    (inner,) = re.findall(r"(?s)<article[^>]*>(.*?)</article>", page)
    inner = re.sub(r'(?s)<(div|aside|section)[^>]*class="(?:ad|share|related|comments?|promo|newsletter|sidebar|cookie)[^"]*".*?</\1>', "\0", inner)
    parts = [re.sub(r"<[^>]*>", "", re.sub(r"(?i)<br\s*/?>", " ", x)) for x in re.split(BLOCK, inner)]
    return "\n\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts) if x)


def test_op5(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = run(spark, "op5_html_extract")
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_op6(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counts = [len(e.ids) for e in t.encode_batch([d.text or "" for d in docs], add_special_tokens=False)]
    want = sorted((d.doc_id, len((d.text or "").encode()), n, n > 1024) for d, n in zip(docs, counts))
    assert sorted(map(tuple, run(spark, "op6_token_count"))) == want


def test_op8(spark, docs):
    """Every text without its spans, and every span of 25 words or more, most of them in stretches that other texts hold too."""
    raw = {d.doc_id: (d.text or "").encode() for d in docs}
    places = collections.defaultdict(set)
    for doc_id, text in raw.items():
        words = text.split()
        for k in range(len(words) - 7):
            places[tuple(words[k : k + 8])].add((doc_id, k))
    shared = total = 0
    for r in run(spark, "op8_substring_dedup"):
        text, last, left = raw[r.doc_id], 0, b""
        for s in r.spans:
            words = text[s.start : s.end].split()
            assert len(words) >= 25
            total += len(words) - 7
            shared += sum(len(places[tuple(words[k : k + 8])]) > 1 for k in range(len(words) - 7))
            left += text[last : s.start]
            last = s.end
        assert (r.text or "").encode() == left + text[last:] and r.n_removed == sum(s.end - s.start for s in r.spans)
    assert total and shared / total > 0.9


def test_op10(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = run(spark, "op10_packing")
    n = check_packing(rows, docs, lambda x: t.encode(x, add_special_tokens=False))
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1
