import json
import random

import edges
import pytest

from echofind.llm import queries, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as file:
        return token_counts.Counter(token_counts.Vocabulary(file.read()))


def wanted(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_whole_tokens_are_those_of_the_library(library, counter):
    texts = [library.decode([i], skip_special_tokens=False) for i in range(library.get_vocab_size())]
    alone = {t for i, t in enumerate(texts) if t != "<|endoftext|>" and [p[0] for p in library.pre_tokenizer.pre_tokenize_str(t)][1:] == []}
    single = {t for t in alone if "�" not in t and wanted(library, t) == 1}
    assert single <= set(counter.vocabulary.whole) and len(single) > 45_000
    assert all(wanted(library, t) == 1 for t in counter.vocabulary.whole if t in alone)


def test_merges_equal_the_library(library, counter):
    r = random.Random(3)
    signs = [*" '\n\t sdtmrelvDon12½²３ é漢字.!?_-\x1c\x85😀ßZ ́՘\U0001e6c0", "'re", "'ll", " 's", "''s", "  ", "<|endoftext|>", "<|endof"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 5000, "ab" * 3000, " " * 999, "'" * 40, "don't we'll I've 'sfoo 'r 've", edges.prose(1, 3000), "<|endoftext|>" * 3]
    texts += ["".join(r.choices("abcdefghij", k=400)) for _ in range(30)]
    whole = counter.vocabulary
    for text in texts[-30:] + ["a" * 40, "zq" * 20]:
        assert whole._merge_long(text.encode()[:40]) == whole.merge(text.encode()[:40])
    for text in texts:
        assert counter.count(text.encode()) == wanted(library, text), text


def test_every_code_point_is_cut_as_in_the_library(library, counter):
    for low in range(0, 0x110000, 0x4000):
        text = "".join(f"a{chr(c)}b1{chr(c)}2!{chr(c)} " for c in range(low, low + 0x4000, 7) if not 0xD800 <= c < 0xE000)
        assert counter.count(text.encode()) == wanted(library, text)
    for run in token_counts.NEW_LETTERS.split():
        for c in {int(end, 16) for end in run.split("-")}:
            text = f"a{chr(c)}b 1{chr(c)} !{chr(c)}"
            assert counter.count(text.encode()) == wanted(library, text)


def test_forgetting_changes_nothing(library, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 400)
    small = token_counts.Counter(counter.vocabulary)
    monkeypatch.setattr(token_counts, "LONG", 100)
    text = edges.prose(7, 4000)
    assert [small.count(text.encode()), small.count(text.encode())] == [wanted(library, text)] * 2
    assert len(small) <= len(counter.vocabulary.whole) + 50


def test_long_texts(spark, library):
    texts = ["word " * 1_100_000, "zq" * 300_000, "é漢字 naïve 😀\n" * 200_000]
    found = token_counts.count(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), PATH)
    assert {r["row"]["doc_id"]: r["n_tokens"] for r in found.collect()} == {i: wanted(library, t) for i, t in enumerate(texts)}


def test_edges(spark, library, tmp_path):
    docs = edges.documents(spark)
    rows = token_counts.count(docs, PATH, limit=50).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["row"]["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), wanted(library, text))
        assert r["over_limit"] == (r["n_tokens"] > 50) and r["row"]["n_tokens"] == "mine"
    assert token_counts.count(edges.empty(spark), PATH).count() == 0
    folder = edges.write(spark, tmp_path, documents=docs)
    assert queries.op12_token_counts(spark, folder).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_query_equals_the_library(spark, library, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op12_token_counts(spark, sf_dir).collect():
        n = wanted(library, texts[r["doc_id"]])
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 1024)


def test_other_tokenizers_are_refused():
    with open(PATH, encoding="utf-8") as file:
        made = json.load(file)
    made["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        token_counts.Vocabulary(json.dumps(made))
