"""Near words by the tries are those by trying all pairs; forms and roots follow from them."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from silverleaf.llm import spelling_variants as spelling

from .data import AWKWARD, CLASH, awkward, empty


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def some_words(n=700):
    rng = random.Random(2)
    made = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(n)}
    long = "abcÿ" * 20
    return sorted(made | {long, long + "x", long[:40] + long[41:], "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"})


@pytest.mark.parametrize("cells,together", [(1 << 19, 1 << 20), (300, 500), (20, 1)])
def test_pairs_are_all_those_at_distance_one(spark, cells, together):
    words = some_words()
    want = sorted((a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and near(a, b))
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    assert sorted((r["word"], r["other"]) for r in spelling.near_words(df, cells, together).collect()) == want


def test_active_nodes_walk_two_tries_side_by_side():
    words = ["ab", "abc", "b", "ab", "xb"]  # tries 0: ab abc b, 1: ab xb
    letters = np.array([[ord(c) for c in w.ljust(3, "\0")] for w in words])
    a, b = spelling.Forest(np.array([0, 0, 0, 1, 1]), letters, np.array([2, 3, 1, 2, 2])).pairs()
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 1), (0, 2), (1, 0), (2, 0), (3, 4), (4, 3)]


def expected(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}
    close = {w: [x for x in words if x != w and near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(close[w]), words.get(form[w]))
    return out


def test_forms_and_roots(spark):
    texts = [(1, "receive " * 200 + "recieve receeve " * 15 + "recieves Recieves"), (2, "receeves receeves receeves"), (3, "RECEIVE Éclairs éclairs éclairs × naïve÷naïves"), (None, "naïve÷naïves")]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, word string").withColumnsRenamed({})
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(spelling.vocabulary(df)).collect()}
    assert got == expected(texts)
    chain = [("aaaaaaa", 1000), ("aaaaaaab", 100), ("aaaaaaabb", 10), ("aaaaaabbb", 1), ("aaaaaaac", 100)]
    rows = {r["word"]: r for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert {w: (r["form"], r["root"]) for w, r in rows.items()} == {
        "aaaaaaa": (None, "aaaaaaa"), "aaaaaaab": ("aaaaaaa", "aaaaaaa"), "aaaaaaac": ("aaaaaaa", "aaaaaaa"), "aaaaaaabb": ("aaaaaaab", "aaaaaaa"), "aaaaaabbb": ("aaaaaaabb", "aaaaaaa"),
    }


def test_awkward_rows(spark):
    assert CLASH
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(spelling.vocabulary(awkward(spark))).collect()}
    assert got == expected([r[:2] for r in AWKWARD])
    assert spelling.variants(spelling.vocabulary(empty(spark))).count() == 0
