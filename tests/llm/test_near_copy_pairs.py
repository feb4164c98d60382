"""Groups of many near copies: links as by brute force, and few joined rows for copies that link with nothing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyfield.llm import jaccard


def shingles(text, size):
    w = re.findall("[^\x20\x09-\x0d]+", text.lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_force(rows, size, percent):
    sets, root = {i: shingles(t, size) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in sets.items():
        for b, y in sets.items():
            if b < a and x and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def edited(base, edits, name):
    """``base`` with so many words replaced, spread over it, so that each takes as many shingles as it can."""
    out = list(base)
    for k in range(edits):
        out[(2 * k + 1) * len(base) // (2 * edits)] = f"{name}x{k}"
    return " ".join(out)


@pytest.mark.parametrize("size, percent, heads", [(4, 85, 3), (4, 85, 1), (5, 80, 1)])
def test_groups_equal_brute_force(spark, monkeypatch, size, percent, heads):
    monkeypatch.setattr(jaccard, "HEADS", heads)
    draw, rows = random.Random(4), []
    for group, n in enumerate((12, 30, 60, 150)):
        base = [f"g{group}w{draw.randrange(10_000)}" for _ in range(n)]
        for _ in range(25):
            copy = list(base)
            for _ in range(draw.randrange(5)):
                copy[draw.randrange(n)] = f"e{draw.randrange(8)}"
            rows.append((len(rows), " ".join(copy + base[: draw.randrange(3)])))
    rows += [(len(rows), ""), (len(rows) + 1, " ".join(rows[40][1].split() * 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in jaccard.near_duplicates(docs, size, percent).collect()} == brute_force(rows, size, percent)


def test_copies_edited_too_much_meet_nothing(spark):
    base = [f"w{i}" for i in range(150)]  # 147 shingles: three edits leave 135 of 159, below 85 %
    rows = [(i, edited(base, 3 if i >= 20 else 1, f"d{i}")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    join = jaccard.Join(docs, jaccard.SHINGLE, jaccard.PERCENT)
    join.members()
    x, y = join.prefixes().alias("x"), join.prefixes().alias("y")
    met = x.join(y, F.expr(f"x.sig = y.sig and x.c < y.c and {join.near('x.n', 'y.n')} and {join.early('x.i', 'y.i', 'x.n', 'y.n')}"))
    alone = sorted(r["c"] for r in join.members().where("doc_id >= 20").collect())
    assert len(alone) == 60
    assert met.where(F.col("x.c").isin(alone) | F.col("y.c").isin(alone)).count() == 0
    assert met.count() > 0
