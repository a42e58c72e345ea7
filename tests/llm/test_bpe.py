import base64
import random

import edges
import numpy as np
import pyarrow as pa
import pytest

from echofind.llm import bpe
from echofind.llm.common import blocks

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.Ranks(file.read())


def encoded(texts, ranks):
    corpus, out = bpe._Corpus(), []
    for rows, data, offsets in blocks(iter(pa.table({"text": pa.array(texts, pa.string())}).to_batches()), limit=10_000):
        corpus.add(rows, data, offsets)
    for _, ids, first in corpus.encode(ranks):
        raw, ends = ranks.decode(ids, first)
        out += [(ids[a:b].tolist(), raw[x:y].tobytes()) for a, b, x, y in zip(first, first[1:], ends, ends[1:])]
    return out


def test_equals_the_plain_encoder(reference, ranks):
    r = random.Random(1)
    signs = [*" '\n\t sdtmrelvDon12½²३ é漢字.!?_-\x1c\x85😀ßZ ́", "'re", "'ll", " 's", "''s", "  ", "<|endoftext|>"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(3000)]
    texts += ["", None, "a" * 2000, "ab" * 1000, " " * 999, "'" * 40, "don't we'll I've 'sfoo 'r 've", edges.prose(1, 3000)]
    for text, (ids, raw) in zip(texts, encoded(texts, ranks), strict=True):
        assert ids == reference.encode_ordinary(text or ""), text
        assert raw == (text or "").encode()


def test_pieces_of_equal_hash_are_told_apart(reference, ranks, monkeypatch):
    letters = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    texts = [letters, letters.translate(str.maketrans("ab", "ba")), letters + " " + letters[::-1]]
    assert [ids for ids, _ in encoded(texts, ranks)] == [reference.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: ends - starts)  # all of a length collide
    texts += [edges.prose(4, 200), None, "", "one two six ten"]
    for text, (ids, raw) in zip(texts, encoded(texts, ranks), strict=True):
        assert ids == reference.encode_ordinary(text or "") and raw == (text or "").encode()


def test_edges(spark, reference):
    docs = edges.documents(spark)
    out = bpe.encode(docs, PATH, check=True)
    assert set(out.columns) == set(docs.columns) | {"n_tokens", "ids", "decoded"}
    for r in out.collect():
        text = r["text"] or ""
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids == reference.encode_ordinary(text) and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
        assert r["row"] == "mine"
    again = bpe.decode(bpe.encode(docs.select("doc_id", "text"), PATH), PATH).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in again)
    assert bpe.encode(edges.empty(spark), PATH, check=True).count() == 0
