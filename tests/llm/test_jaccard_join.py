"""Links are those of all pairs; groups may be spread over blocks without losing any."""

import random
import re

import numpy as np
import pytest
from silverleaf.llm import jaccard_join as join

from .data import AWKWARD, awkward, empty


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def near_copies():
    rng = random.Random(5)
    base, out = [f"w{k}" for k in range(120)], []
    for k in range(250):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        out.append((k + 3, " ".join(w[: rng.randint(100, 120)] if rng.random() < 0.2 else w)))
    out += [(1000 + k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for k in range(80)]
    out += [(2000 + k, "a line that all of these documents share with one another " + " ".join(rng.choice("abcdefgh") * 3 for _ in range(30))) for k in range(40)]
    lost = "only here twice and more words than that"
    return [*out, (7, None), (8, ""), (None, out[5][1]), (None, lost), (None, lost)]


@pytest.mark.parametrize("block", [1024, 40, 7])
def test_components_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(join, "BLOCK", block)
    if block < 1024:
        for name, value in (("LEFT", block // 2), ("COLUMNS", 64), ("ROWS", 16), ("BROADCAST", 3)):
            monkeypatch.setattr(join, name, value)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, join.linked(df).collect()), key=str) == expected(rows)


def test_linked_sets_share_a_signature():
    rng = random.Random(6)
    linked = 0
    for _ in range(3000):
        n = rng.choice([1, 2, 8, 9, 10, 11, 12, 19, 20, 30, 57, 100, 300])
        pool = [rng.getrandbits(63) for _ in range(n + n // 5 + 3)]
        a = set(pool[:n])
        b = set(a)
        for _ in range(rng.randint(0, max(1, n // 10))):
            if rng.random() < 0.5 and len(b) > 1:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.choice(pool))
        both = len(a & b)
        if a != b and 100 * both >= 90 * len(a | b):
            assert both >= join.least_overlap(len(a) + len(b))
            linked += 1
            one, two = (set(join.signatures(np.array(sorted(x), np.uint64)).tolist()) for x in (a, b))
            assert one & two
    assert linked > 300


def test_product_is_that_of_all_pairs():
    rng = random.Random(8)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 50)))) for _ in range(70)]
    sets += [np.array(sorted(set(range(40)) - {k})) for k in range(20)]
    m, apart, other = join.Matrix(sets), np.full(len(sets), -1), np.zeros(len(sets))
    good = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))}
    found = [(int(i), int(j)) for x, y in join.product(m, m, apart, other, True) for i, j in zip(x, y)]
    assert sorted(found) == sorted(p for p in good if p[0] < p[1])
    label = np.arange(len(sets)) % 3
    found = {(int(i), int(j)) for x, y in join.product(m, m, label, label, False) for i, j in zip(x, y)}
    assert found == {(i, j) for i, j in good if label[i] != label[j]}


def test_awkward_rows(spark):
    assert sorted(map(tuple, join.linked(awkward(spark)).collect()), key=str) == expected([r[:2] for r in AWKWARD])
    assert join.linked(empty(spark)).count() == 0
