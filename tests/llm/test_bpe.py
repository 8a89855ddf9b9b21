import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from segmill.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
REF = tiktoken.Encoding("ref", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})
CODECS = [bpe.TreeCodec(RANKS, P.PATTERN, leaf) for leaf in (8, 13, 64)]
ALPHABET = "aab's tre lldmv\n\t  01!'\"...éÉß日本語😀 　́٣\x1c\x85"


def agrees(text):
    for c in CODECS:
        ids = c.encode(text)
        assert ids == REF.encode_ordinary(text), (c.leaf, text)
        assert c.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=300))
def test_tree_equals_library(text):
    agrees(text)


@pytest.mark.parametrize("text", ["", " ", "'", "a" * 999, " " * 500, "'s" * 300, "ab" * 400 + " " * 100 + "\n" * 77 + "x", "!" * 300 + "'ll" * 99, "日本語" * 200, "😀" * 200, "1234567890" * 60])
def test_runs(text):
    agrees(text)


def test_random_runs_of_one_class():
    rnd = random.Random(1)
    for letters in ("abcdefghij", "eau", "th'", "éàü", "0123", ".,;!"):
        for _ in range(30):
            agrees("".join(rnd.choice(letters) for _ in range(rnd.randrange(400))))


def test_frames(spark):
    rows = [(1, "Hello world", "x"), (None, None, "y"), (1, "Hello world", "x"), (2, "", None), (3, "añb " * 9000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in out) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert all(r.token_ids == REF.encode_ordinary(bytes(r.decoded).decode()) for r in out)
    both = bpe.round_trip(docs.withColumn("decoded", docs.doc_id), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.token_ids, bytes(r.decoded)) for r in both) == sorted((r.doc_id or 0, r.token_ids, bytes(r.decoded)) for r in out)
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_other_patterns():
    """Of patterns that the proofs do not cover, texts are encoded whole."""
    pattern = r"\p{N}{1,3}|\p{L}+|[^\p{L}\p{N}]+"
    ref = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=REF._mergeable_ranks, special_tokens={})
    codec = bpe.TreeCodec(RANKS, pattern, 8)
    rnd = random.Random(2)
    for _ in range(300):
        t = "".join(rnd.choice("0123456789ab .") for _ in range(200))
        assert codec.encode(t) == ref.encode_ordinary(t)
    assert P.PATTERN in bpe.PROVEN
