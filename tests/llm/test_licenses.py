import random
from functools import lru_cache

import edges

from echofind.llm import licenses


def plain(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text).split()


def test_patience_never_beats_the_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(300):
        a, b = (tuple(r.choices("abcdefgh", k=r.randint(0, 9))) for _ in range(2))

        @lru_cache(None)
        def lcs(i, j):
            if i == len(a) or j == len(b):
                return 0
            return lcs(i + 1, j + 1) + 1 if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

        pairs = licenses.patience(list(a), list(b))
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) <= lcs(0, 0)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(pairs) == lcs(0, 0)  # unique words: the longest rise is the longest alignment


def test_no_stretch_is_passed_over():
    """Every stretch of a text, aligned: the search finds a notice exactly where one does."""
    r = random.Random(5)
    templates = (("x", "Licensed under the Example License, Version 7."), ("y", "Released under the Other License."))
    matcher = licenses.Matcher(templates, 0.8)
    import numpy as np

    words = plain(templates[0][1] + " " + templates[1][1]) + ["the", "a", "of", "über"]
    for _ in range(400):
        text = r.choices(words, k=r.randint(0, 14)) + r.choice([[], plain(templates[0][1])]) + r.choices(words, k=r.randint(0, 5))
        raw = np.frombuffer(" ".join(text).encode(), np.uint8)
        names = {n for n, *_ in matcher.matches(raw, np.array([0, len(raw)]))[0]}
        wanted = set()
        for name, template in templates:
            t = plain(template)
            width, need = -(-len(t) * 3 // 2), -(-len(t) * 4 // 5)
            if any(len(licenses.patience(text[i : i + width], t)) >= need for i in range(len(text))):
                wanted.add(name)
        assert bool(names) == bool(wanted) and names <= wanted


def test_notices(spark):
    mit = licenses.TEMPLATES[2][1]
    texts = [
        "é " + mit,
        f"{mit} {mit}",
        edges.prose(1, 4000) + " LICENSED under\nthe *Apache* license (version 2.0) " + edges.prose(2, 4000),
        "the license under which it was released",
        licenses.TEMPLATES[1][1] + " tail",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: [tuple(n) for n in r["notices"]] for r in licenses.notices(df).collect()}
    assert got[0] == [("mit", 1.0, 2, 32)]
    assert [n[:2] for n in got[1]] == [("mit", 1.0)] * 2
    name, coverage, a, b = got[2][0]
    assert (name, coverage) == ("apache-2.0", 1.0) and texts[2][a:b].split()[0] == "LICENSED" and texts[2][:b].endswith("2.0")
    assert got[3] == [] and [n[:2] for n in got[4]] == [("apache-2.0", 1.0)]


def names(text, templates=licenses.TEMPLATES):
    import numpy as np

    raw = np.frombuffer(text.encode(), np.uint8)
    return [n[:2] for n in licenses.Matcher(templates, 0.8).matches(raw, np.array([0, len(raw)]))[0]]


def test_every_template_is_itself():
    for name, text, *_ in licenses.TEMPLATES:
        assert names(text) == [(name, 1.0)]
        assert names("so " + text.upper() + " " + text) == [(name, 1.0)] * 2


def test_siblings_of_a_license_are_not_taken_for_it():
    gpl = "redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
    other = [f"Licensed under CC BY{v}." for v in ("-ND 4.0", "-NC-ND 4.0", "-NC-SA 4.0", " 3.0", "-SA 3.0", "-NC 2.5")]
    other += ["Released under the BSD License", "released under the license", "Released under the ISC License."]
    other += [f"This work is licensed under the GNU {w}" for w in ("General Public License, version 2.", "Lesser General Public License, version 3.")]
    other += ["This work is licensed under the GNU Affero General Public License, version 3."]
    other += ["Licensed under the Mozilla Public License, Version 2.0", "Licensed under the Apache License, Version 1.1."]
    other += ["This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0."]
    other += ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."]
    for family in ("General Public License", "Lesser General Public License", "Affero General Public License"):
        for version in (2, 3) if family[0] != "G" else (2,):
            text = "This program is free software: you can " + gpl.format(family)
            other += [f"{text}, either version {version} of the License, or (at your option) any later version"]
            other += [text.replace(" as pub", f" version {version} as pub")]
    other += [licenses.TEMPLATES[3][1].replace("deal in", "deal with")]
    other += ["Redistribution and use in source and binary forms, without modification, are permitted provided that the following conditions are met"]
    for text in other:
        assert names(text) == [], text


def test_wordings_of_the_same_license():
    assert names("This work is licensed under the GNU General Public License v3") == [("gpl-3.0", 11 / 12)]
    assert names("Licensed under the Apache Software License, version 2") == [("apache-2.0", 7 / 8)]
    assert names("licensed under (CC BY-SA), version 4.0") == [("cc-by-sa-4.0", 1.0)]
    # the longer wording with a word less still spans the notice
    assert names(licenses.TEMPLATES[1][1].replace("compliance", "agreement")) == [("apache-2.0", 1 - 1 / len(plain(licenses.TEMPLATES[1][1])))]
    both = "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0. Licensed under CC BY-ND 4.0."
    assert names(both) == [("cc-by-4.0", 1.0), ("cc-by-nc-4.0", 1.0)]


def test_coverage_comes_before_matched_words():
    templates = (("long", "alpha beta gamma delta omega"), ("short", "alpha beta gamma delta"))
    assert names("alpha beta gamma delta", templates) == [("short", 1.0)]


def test_edges(spark):
    docs = edges.documents(spark)
    got = licenses.notices(docs).collect()
    assert len(got) == 14 and not any(r["notices"] for r in got) and set(got[0]["row"].asDict()) == set(docs.columns)
    assert licenses.notices(edges.empty(spark)).count() == 0
    assert licenses.notices(docs, templates=()).where("size(notices) > 0").count() == 0
