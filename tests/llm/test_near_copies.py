"""The near-copy stage of the pipeline against a brute-force Jaccard on five words."""

import random
import re

import pytest

import corpus_pipeline


def shingles(text, size):
    w = re.findall("[^\x20\x09-\x0d]+", text.lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def jaccard(a, b, size):
    x, y = shingles(a, size), shingles(b, size)
    return 100 * len(x & y), len(x | y)


def brute_force(rows):
    """Ids that stay: the least of each component of pairs with a 5-word Jaccard of 0.80."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in rows:
        for b, y in rows:
            shared, all_ = jaccard(x, y, 5)
            if b < a and all_ and shared >= 80 * all_:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i for i in root if find(i) == i}


@pytest.fixture(scope="module")
def rows():
    draw, out = random.Random(8), [(1, ""), (2, "a b c"), (3, "A b c"), (4, "a b c d")]
    for group, n, edits in [(0, 188, 4), (1, 235, 5), (2, 282, 6), (3, 180, 3), (4, 180, 6), (5, 90, 2), (6, 45, 1), (7, 400, 0)]:
        base = [f"g{group}w{draw.randrange(10_000)}" for _ in range(n)]
        copy = list(base)
        for k in range(edits):  # apart and inside, so that each edit takes five shingles
            copy[(2 * k + 1) * n // (2 * edits)] = f"edit{group}x{k}"
        out += [(10 + 2 * group, " ".join(base)), (11 + 2 * group, " ".join(copy))]
    return out


def test_stage_equals_five_word_brute_force(spark, rows):
    texts = dict(rows)
    between = [i for i in range(10, 26, 2) if jaccard(texts[i], texts[i + 1], 5)[0] >= 80 * jaccard(texts[i], texts[i + 1], 5)[1] and jaccard(texts[i], texts[i + 1], 4)[0] < 85 * jaccard(texts[i], texts[i + 1], 4)[1]]
    assert len(between) >= 3  # pairs that four words and 0.85 do not link
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == brute_force(rows)
