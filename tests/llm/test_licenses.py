import math
import random

import numpy as np
import pytest

from sparkwarden.llm import licenses, templates
from sparkwarden.llm.templates import MIT, TEMPLATES

#: One short template of each kind, as texts of the tests.
WORDING = {k: t for k, t in reversed(TEMPLATES) if "\n" not in t and not t.startswith("SPDX")}


def test_scan():
    for name, text in TEMPLATES:
        got, score, _ = licenses.scan("Some words first\n\n" + text + "\n\nand more of them after it")
        assert score > 0.99 and got == name, (name, text[:80], got, score)
    assert licenses.scan(None) == licenses.scan("") == (None, 0.0, 0.0)
    assert licenses.scan("the version of a general work\nof public use")[1] < licenses.LEAST


def test_header_inside_a_line():
    name, score, whole = licenses.scan("Thing erea onth. Released under the MIT License. Onth erea tion inga")
    assert name == "MIT" and score >= licenses.LEAST > whole


def test_header_among_any_number_of_other_words():
    for name, text in TEMPLATES:
        for before, after in ((0, 0), (1, 0), (0, 3), (2, 2), (10, 10)):
            got, score, _ = licenses.scan(f"{'onth ' * before}{text} {'erea ' * after}")
            assert score >= licenses.LEAST and got == name, (name, text[:60], before, after, got, score)
    for text, want in (("Copyright 2020 Foo. Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("GNU GENERAL PUBLIC LICENSE", "GPL-3.0"), ("// SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"), ("# SPDX-License-Identifier: MIT", "MIT"), ("Released under the LGPL version 3.", "LGPL-3.0")):
        assert licenses.scan(f"{text}\n\nonth erea tion")[0] == want


def test_wrapped_comments_and_whole_files():
    notice = dict(zip([t for _, t in templates.notices("GPL", "3.0")], range(9)))
    text = next(iter(notice)).split()
    wrapped = "/*\n" + "\n".join(" * " + " ".join(text[i : i + 9]) for i in range(0, len(text), 9)) + "\n */\nint onth() { erea; }\n" * 1
    name, score, _ = licenses.scan(wrapped)
    assert name == "GPL-3.0" and score >= licenses.LEAST
    name, score, whole = licenses.scan("MIT License\n\nCopyright (c) 2020 Onth Erea\n\n" + MIT.replace(". ", ".\n"))
    assert name == "MIT" and whole >= licenses.WHOLE


def test_cosine_against_dense_vectors():
    """The same by other means: dense vectors over all words of the templates and the texts."""
    rng = random.Random(3)
    vocabulary = [w for _, t in TEMPLATES for w in licenses.bag(t)]
    texts = [" ".join(w.decode() for w in rng.choices(vocabulary, k=rng.randrange(1, 40)) + rng.choices([b"onth", b"erea", b"tion"], k=rng.randrange(0, 5))) for _ in range(80)]
    texts += [t for _, t in TEMPLATES]
    bags = [licenses.bag(t) for t in texts]
    docs = [licenses.bag(t) for _, t in TEMPLATES]
    every = sorted({w for x in (*bags, *docs) for w in x})
    dense = lambda xs: np.array([[x.count(w) for w in every] for x in xs], float)
    d = dense(docs)
    idf = 1 + np.log((1 + len(docs)) / (1 + (d > 0).sum(0)))
    a, b = dense(bags) * idf, d * idf
    want = (a @ b.T) / np.sqrt((a**2).sum(1))[:, None] / np.sqrt((b**2).sum(1))[None, :]
    for i, x in enumerate(bags):
        s, k = licenses.cosine(licenses.Counter(x))
        assert math.isclose(s, want[i].max(), abs_tol=1e-9) and want[i, k] > want[i].max() - 1e-9


def test_inheritance(spark):
    mit, gpl, text = TEMPLATES[0][1], "This work is licensed under the GNU General Public License, version 3.", "words " * 50
    rows = [
        (1, "LICENSE", mit), (2, "a/x.py", text), (3, "a/b/COPYING.txt", text + "\n" + gpl), (4, "a/b/y.py", text), (5, "a/b/c/d/z.py", text),
        (6, "a/b/q.py", text + "\n" + "All rights reserved."), (7, None, text), (8, "a/e/w.py", None), (9, "a/e/v.py", ""), (9, "a/e/v.py", ""), (10, "ab/LICENSES-of/u.py", text),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 as dir", "'x' as license")
    got = {r["doc_id"]: (r["license"], r["kind"], r["license_dir"]) for r in licenses.inherit(df).collect()}
    root = ("MIT", "inherited", "")
    assert got == {
        1: ("MIT", "file", None), 2: root, 3: ("GPL-3.0", "file", None), 4: ("GPL-3.0", "inherited", "a/b"), 5: ("GPL-3.0", "inherited", "a/b"),
        6: ("proprietary", "header", None), 7: root, 8: root, 9: root, 10: root,
    }
    assert licenses.inherit(df).count() == len(rows)
    assert licenses.inherit(df.limit(0)).collect() == []
    assert {r["license"] for r in licenses.inherit(df.where("doc_id in (2, 5)")).collect()} == {None}


def test_ties(spark):
    rows = [(1, "a/LICENSE", WORDING["MIT"]), (2, "a/COPYING", WORDING["ISC"]), (3, "a/x", "y")]
    got = licenses.inherit(spark.createDataFrame(rows, "doc_id long, path string, text string")).where("doc_id = 3").collect()
    assert got[0]["license"] == "ISC" and got == licenses.inherit(spark.createDataFrame(rows[::-1], "doc_id long, path string, text string")).where("doc_id = 3").collect()


def test_string_ids(spark):
    df = spark.createDataFrame([("x1", "s", "words"), (None, None, None)], "doc_id string, source string, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.inherit(licenses.document_paths(df)).collect()} == {"x1": None, None: None}


@pytest.mark.parametrize("name", list(templates.LONG) + ["AGPL-3.0"])
def test_long_licences(spark, name):
    """Whole texts, with and without what follows their terms, laid out anew, with a copyright line before, under any name."""
    for found, text in templates.long_texts():
        if found != name:
            continue
        for t in (text, f"Copyright 2024 Somebody\n\n{text}", " ".join(text.split()), text.replace("\n", "\r\n")):
            own, score, whole = licenses.scan(t)
            assert own == name and score == whole >= licenses.LONG
    texts = dict(templates.long_texts())
    df = spark.createDataFrame([(1, "a/whatever.txt", texts[name]), (2, "a/b/code.py", "x = 1"), (3, "c/code.py", "x = 1")], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.kind) for r in licenses.inherit(df).collect()}
    assert got == {1: (name, "file"), 2: (name, "inherited"), 3: (None, None)}


def test_long_prose_is_no_licence():
    texts = [r for _, r in templates.long_texts()]
    words = [w for t in texts for w in t.split()]
    assert licenses.scan(" ".join(words[i] for i in range(0, len(words), 37)))[2] < licenses.LONG
