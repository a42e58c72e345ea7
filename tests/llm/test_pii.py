import hashlib
import random
import re

import edges

from echofind.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def found(spark, texts, **settings):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.digest(*pii.find(df, ["doc_id"], **settings)).select("row.doc_id", "*").drop("row").collect()
    return {r["doc_id"]: r for r in rows}


def test_base_equals_plain_patterns(spark):
    r = random.Random(8)
    bits = ["a", "b9", "@", ".", "c-d", "_", " ", "1", "22", "300", "4", "+", "(", ")", "-", "é", "😀", "a@b.cd", "1.2.3.4", "+49 (30) 1234567"]
    bits += ["4111 1111 1111 1111", "4111111111111112", "\n", "x@y.z_w@v.u", "0000255.1.1.1", "5500-0000-0000-0004"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 30))) for _ in range(600)]
    texts += ["a" * 3_000, "1" * 3_000, "1 " * 3_000, "+1" + " " * 3_000, "a@" * 1_000, None, ""]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(base(t).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [base(t).count(f"{k}:") for k in pii.KINDS]


def test_contexts_discover_unseen_identifiers(spark):
    texts = [f"please use member no. {w} +49 30 1234{k}67 today" for k, w in enumerate(["", "", "", ""])]
    texts += [f"he has card number 4111 1111 1111 111{d} now" for d in "1"]
    texts += [f"write to: contact me user{k}@example.org soon" for k in range(5)]
    texts += ["write to: contact me user_at_example99 soon", "the year contact 12345678 me"]
    got = found(spark, texts)
    assert "id:21:38" in got[len(texts) - 2]["spans"]  # led to by the contexts of the addresses
    assert got[len(texts) - 1]["spans"] == ""


def test_a_context_that_stands_before_anything_is_not_trusted(spark):
    texts = [f"went to the u{k}@example.org" for k in range(4)] + ["went to the 99887766x"]
    texts += ["to the house and to the river and to the sea"] * 5
    assert found(spark, texts)[4]["spans"] == ""


def patterns(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.mentions(pii.scan(df, ["doc_id"])).collect()
    return {r["match"]: r["pattern"] for r in rows}


def test_contexts_do_not_end_at_earlier_mentions(spark):
    texts = [
        "2021-03-04 patient 99887766",
        "so a@x.org and b@y.org",
        "my id:11887766 (22887766 no=33887766",
        "44887766 at the start",
        "Patient: 55887766",
        "x" * 200 + " no   \n" + " " * 300 + "66887766",
        "the 12/24/2021 10:15:30 é77887766 tel+49 30 1234567",
    ]
    got = patterns(spark, texts)
    assert got["99887766"] == "0 patient" and got["2021-03-04"] == "^ ^"
    assert got["b@y.org"] == "org and" and got["a@x.org"] == "^ so"
    assert (got["11887766"], got["22887766"], got["33887766"]) == ("my id", "id 0", "0 no")
    assert got["44887766"] == "^ ^" and got["55887766"] == "^ patient" and got["66887766"] is None
    assert got["10:15:30"] == "0 0" if "10:15:30" in got else True
    assert got["77887766"] is None and got["+49 30 1234567"] == "é0 tel"


def test_occurrences_split_words_as_mentions_do(spark):
    texts = ["id:1234567, ID = 7654321; my-id (5555555)", "", None, "?!", "2021-03-04 patient 99887766", "Patient 12345678 and a@x.org"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = pii.mentions(pii.scan(df, ["doc_id"])).where("kind in ('id', 'email') and pattern is not null")
    hits = {r["pattern"]: r["count"] for r in spans.groupBy("kind", "pattern").count().collect()}
    n = {r["pattern"]: r["n"] for r in pii._occurrences(df, spans.select("pattern").distinct()).collect()}
    assert len(hits) > 5 and set(n) == set(hits) and all(n[p] >= h for p, h in hits.items())
    assert n["0 patient"] == 3 and n["^ patient"] == 3


def test_identifiers_that_crowd_are_found(spark):
    texts = [f"2021-03-0{k + 1} mail:u{k}@example.org" for k in range(6)] + ["2021-04-07 mail:99887766", "2021-04-08 sum:99.50"]
    got = found(spark, texts)
    assert got[6]["spans"] == "id:16:24" and got[7]["spans"] == ""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["text"] for r in pii.mask(df).collect()} >= {"2021-04-07 mail:<ID>", "2021-04-08 sum:99.50"}


def test_rounds_go_on_until_nothing_changes(spark):
    """Each context leads to what the one before found, and to three more."""
    named = [[f"u{k}@example.org" for k in range(3)]] + [[f"{n}9988{k}77" for k in range(3)] for n in range(7)]
    texts = [", ".join(f"chain {c} {w}" for w in old * 20 + new) for c, old, new in zip("abcdefg", named, named[1:])]
    got = found(spark, texts)
    assert [got[n]["spans"].count("id:") for n in range(7)] == [3] + [63] * 6


def test_an_instance_is_not_believed_for_patterns_that_are_not(spark):
    texts = [f"seen at place 9988{k}77" for k in range(9)] + [f"at place u{k}@example.org" for k in range(3)]
    assert not any(got["spans"].count("id:") for got in found(spark, texts).values())


def test_edges(spark):
    docs = edges.documents(spark)
    extra = spark.createDataFrame([(20, "mail x@y.org +1 (555) 555-1234 x", "en", "a", 30)] * 2, edges.SCHEMA)
    docs = docs.unionByName(extra, allowMissingColumns=True)
    assert pii.digest(*pii.find(docs, ["doc_id"])).count() == 16
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    rows = [r for r in masked.collect()]
    assert [r["text"] for r in rows if r["doc_id"] == 20] == ["mail <EMAIL> <PHONE> x"] * 2
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["text"] is None for r in rows) == 2
    assert pii.digest(*pii.find(edges.empty(spark), ["doc_id"])).count() == 0
    assert pii.mask(edges.empty(spark)).count() == 0


def test_overlapping_spans_are_masked_together(spark):
    df = spark.createDataFrame([(2, "a@b.co 10.0.0.1@c.de end")], "doc_id long, text string")
    assert [r["text"] for r in pii.mask(df).collect()] == ["<EMAIL> <IP> end"]


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1" + " " * 300_000, "a@" * 100_000, "1." * 100_000]
    got = found(spark, texts)
    assert got[5]["n_ip"] == 25_000 and got[0]["spans"] == ""
