import random
from collections import Counter, defaultdict

import edges

from echofind.llm import near_text


def brute(texts, n=5, threshold=0.8):
    """Links per row and smallest row reached, from all pairs."""
    sets = []
    for t in texts:
        w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    links, root = Counter(), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(find(i), links[i]) for i in range(len(texts))]


def variants(seed, n, base, changes):
    r, out = random.Random(seed), []
    for _ in range(n):
        words = base.split()
        for _ in range(r.randint(0, changes)):
            words[r.randrange(len(words))] = "x" + str(r.randrange(10**6))
        out.append(" ".join(words))
    return out


def test_bands_reach_the_recall():
    bands, rows = near_text.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_text, "CHUNK_BYTES", 20_000)  # many blocks in the large group
    texts = variants(1, 90, edges.prose(1, 150), 4) + variants(2, 20, edges.prose(2, 60), 2) + [edges.prose(9, 50)] * 12
    texts += [edges.prose(k, 40) for k in range(20, 60)] + ["one two", "one two", "", None, "a b c d e"]
    random.Random(4).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_text.join(df).collect()}
    wanted = brute(texts)
    assert sum(n for _, n in wanted) > 2000
    assert [got[i] for i in range(len(texts))] == wanted
    kept = {r["doc_id"] for r in near_text.deduplicate(df).collect()}
    assert kept == {i for i, (root, _) in enumerate(wanted) if root == i}


def test_blocks_of_short_texts_are_bounded_in_members(spark, monkeypatch):
    most, link = [], near_text.pairwise.link

    def watched(members, group, node, size, chunk_size, *rest):
        blocks = near_text.pairwise.deal(members, group, node, size, chunk_size).groupBy("block").count()
        most.extend(r["count"] for r in blocks.collect())
        return link(members, group, node, size, chunk_size, *rest)

    monkeypatch.setattr(near_text.pairwise, "link", watched)
    line = edges.prose(7, 13)
    df = spark.createDataFrame([(k, f"{line} {k}") for k in range(3000)], "doc_id long, text string")
    got = near_text.join(df).collect()
    assert max(most) < 2400 and len(most) > 1
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 2999)}


def test_edges(spark):
    docs = edges.documents(spark)
    got = near_text.join(docs).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append((r["class_id"], r["n_links"], r["copies"]))
    assert len(got) == 14
    assert by_id[1] == [(1, 2, 3)] and by_id[8] == [(1, 2, 3)]
    assert sorted(by_id[None], key=str) == [(1, 2, 3), (None, 0, 1)]
    assert by_id[2] == [(2, 0, 1)] and by_id[3] == [(3, 0, 1)] and by_id[4] == [(4, 0, 1)]
    assert by_id[6] == [(6, 2, 1)] and by_id[7] == [(6, 2, 2)] * 2
    kept = near_text.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda i: i or 0)
    assert ids == [None, 1, 2, 3, 4, 5, 6, 9, 9, 10]
    assert near_text.join(edges.empty(spark)).count() == 0
    assert near_text.deduplicate(edges.empty(spark)).count() == 0


def test_a_repeated_row_stays_once(spark):
    df = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (2, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_text.deduplicate(df).collect()) == [1, 2]


def test_words_of_equal_sums_are_told_apart(spark):
    rest = " one two three four five"
    texts = [edges.THUE, edges.MORSE, edges.THUE, edges.THUE + rest, edges.MORSE + rest]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_text.join(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
