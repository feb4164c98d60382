"""Ranked search, quality trees and whitening against plain loops, held-out rows and odd tables."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallyfield.llm import lexical, quality_trees, whitening
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, sketch string, terms string, kind int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, top):
    cut = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(cut), sum(sum(c.values()) for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        wanted, scores = set(terms(text)), []
        for doc, c in cut:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def searched(spark, docs, items, tmp_path, top=lexical.TOP, parts=3):
    frame = spark.createDataFrame([(i, t, "s", "t", 1) for i, t in docs], DOCS).repartition(parts)
    lexical.build_index(frame, f"{tmp_path}/index")
    found = lexical.search(spark, f"{tmp_path}/index", spark.createDataFrame([(i, t, 9) for i, t in items], "item_id string, text string, rank int"), top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in found.collect()], key=str)


def corpus(n, seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Éa", "ß", "日本", "a1b"]
    rows = [(k, draw.choice([" ", "\n", ", ", "-"]).join(draw.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=draw.randint(0, 60)))) for k in range(n)]
    return rows + [(k, rows[0][1]) for k in range(n, n + 40)] + [(n + 41, "w1 " * 5000 + "w7"), (n + 42, " ".join(f"x{k}" for k in range(4000)) + " w9")]


@pytest.mark.parametrize("top", [1, 5, 50])
def test_search_equals_scoring_every_document(spark, tmp_path, top):
    docs = corpus(400, 1)
    items = [("a", docs[3][1]), ("b", "W1 w7 w300 nowhere"), ("c", "É ß 日本 a1b"), ("d", docs[0][1]), ("none", "!? ..."), ("null", None), ("e", "nowhere")]
    assert searched(spark, docs, items, tmp_path, top) == ranked(docs, items, top)


def test_search_of_odd_tables(spark, tmp_path):
    docs = [(1, "one two"), (1, "one two"), (None, "one two"), (2, None), (3, ""), (4, "!!"), (5, "two")]
    items = [("a", "one"), ("a", "one"), (None, "two")]
    assert searched(spark, docs, items, tmp_path / "x") == ranked(docs, items, 50)
    assert searched(spark, [(2, None)], items, tmp_path / "y") == []
    assert searched(spark, [], items, tmp_path / "z", parts=1) == []
    assert searched(spark, docs, [], tmp_path / "q") == []


def test_search_in_several_blocks_and_statistics(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS_A_BLOCK", 2)
    monkeypatch.setattr(lexical, "TERMS_A_TASK", 20)
    monkeypatch.setattr(lexical, "DOCUMENTS", 7)
    docs = corpus(120, 2)
    items = [(str(k), docs[k][1]) for k in range(5)]
    assert searched(spark, docs, items, tmp_path) == ranked(docs, items, 50)


def test_bounds_hold_and_stop_early():
    docs = corpus(300, 3)
    texts = [t.encode() for _, t in docs if terms(t)]
    counts = [Counter(terms(t.decode())) for t in texts]
    norm = np.array([50 + sum(c.values()) for c in counts])
    sketches = []
    for c in counts:
        width = int(lexical.widths(np.array([len(c)]))[0])
        sketch = np.zeros(width, np.uint8)
        at = (lexical.term_hashes([t.encode() for t in c]) & np.uint64(width - 1)).astype(int)
        np.maximum.at(sketch, at, np.minimum(list(c.values()), lexical.MOST).astype(np.uint8))
        sketches.append(sketch.tobytes())
    lookup = lexical.Lookup([[b"w1", b"w7", b"w200"], [b"w250"]], {b"w1": 100, b"w7": 2000, b"w200": 6000, b"w250": 7000})
    bounds = lookup.bounds(sketches, norm)
    for i, wanted in enumerate(lookup.items):
        exact = np.array([sum(int(lookup.weights[t]) * (10**9 * c[lookup.terms[t].decode()] // (1000 * c[lookup.terms[t].decode()] + 20 * m)) for t in wanted if c[lookup.terms[t].decode()]) for c, m in zip(counts, norm.tolist())])
        assert (bounds[i] >= exact).all()
        assert (bounds[i] >= np.sort(exact)[-5]).sum() < len(texts) / 2  # most documents need no exact score


def test_long_text_is_counted_in_windows(monkeypatch):
    text = ("Alpha beta, gamma " * 500 + "x" * 300).encode()
    whole = lexical.counted([text, b""])
    monkeypatch.setattr(lexical, "WINDOW_BYTES", 100)
    cut = lexical.counted([text])
    assert dict(zip(whole[3], whole[2][np.argsort(whole[1])])) == {t: cut[2][k] for k, t in enumerate(cut[3])} == {b"alpha": 500, b"beta": 500, b"gamma": 500, b"x" * 300: 1}


def test_search_query_equals_its_sql(spark):
    assert compare(lexical.op11_lexical(spark, SF), duck(SF), lexical.SQL) == []


# quality


def test_statistics_equal_plain_loops(monkeypatch):
    texts = ["", "  \n ", "One two two.\nOne two two.\nEnd###", "日本 és\n\nA,b;", "a b c a b c a b c", "x" * 50]
    rows = dict(zip(quality_trees.STATISTICS, quality_trees.statistics([t.encode() for t in texts]).T))
    for k, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [tuple(x.split()) for x in text.split("\n") if x.split()]
        triples = Counter(zip(words, words[1:], words[2:]))
        share = lambda a, b: a / b if b else 0.0
        wanted = {
            "log_points": math.log1p(len(text)), "log_words": math.log1p(len(words)), "log_lines": math.log1p(len(lines)), "word_points": share(sum(map(len, words)), len(words)),
            "longest_word": math.log1p(max(map(len, words), default=0)), "symbol": share(sum(c in "#*$%&|<>" for c in text), len(text)),
            "white": share(sum(c in " \t\n\x0b\x0c\r" for c in text), len(text)), "beyond_ascii": share(sum(ord(c) > 127 for c in text), len(text)),
            "distinct_words": share(len(set(words)), len(words)), "top_word": share(max(Counter(words).values(), default=0), len(words)),
            "same_as_previous": share(sum(a == b for a, b in zip(words, words[1:])), len(words)), "distinct_triples": share(len(triples), sum(triples.values())),
            "top_triple": share(max(triples.values(), default=0), sum(triples.values())), "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
            "symbol_words": share(sum(any(c in "#*$%&|<>" for c in w) for w in words), len(words)), "capital_words": share(sum("A" <= w[0] <= "Z" for w in words), len(words)),
        }
        for name, value in wanted.items():
            assert rows[name][k] == pytest.approx(value), (text, name)
    long = ("Some words here. And # more\n" * 40 + "tail " * 30).encode()
    whole = quality_trees.statistics([long, b"other"])[0]
    monkeypatch.setattr(quality_trees, "WINDOW_BYTES", 64)
    assert quality_trees.statistics([long])[0] == pytest.approx(whole)


def test_flat_trees_equal_walking_each_tree():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(600, 5)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.4)).astype(int)
    forest = quality_trees.grow(x, y, np.ones(len(y)), trees=25)
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.97
    for row, margin in zip(x, forest.margin(x)):
        total = forest.intercept
        for feature, threshold, leaves in zip(forest.feature, forest.threshold, forest.leaves):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaves[node - len(feature)]
        assert margin == pytest.approx(total)


def test_first_split_is_the_best_of_all_cuts():
    draw = np.random.default_rng(5)
    x, y = draw.integers(0, 12, size=(200, 3)).astype(float), draw.integers(0, 2, 200)
    forest = quality_trees.grow(x, y, np.ones(200), trees=1, depth=1)
    p, best = y.mean(), (-1.0, 0, 0.0)
    for f in range(3):
        for cut in sorted(set(x[:, f]))[:-1]:
            sides = [x[:, f] <= cut, x[:, f] > cut]
            if min(s.sum() for s in sides) >= quality_trees.LEAST_WEIGHT:
                gain = sum((p - y[s]).sum() ** 2 / (s.sum() * p * (1 - p) + quality_trees.PENALTY) for s in sides)
                best = max(best, (gain, -f, -cut))
    assert (forest.feature[0, 0], forest.threshold[0, 0]) == (-best[1], -best[2])


def test_quality_of_held_out_documents(spark):
    found = quality_trees.op12_quality(spark, SF).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").df()
    assert len(found) == duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    held = found[found["held_out"]].merge(labels, on="doc_id")
    assert len(held) > 50 and set(held["quality"]) == {0, 1}
    assert (held["predicted"] == held["quality"]).mean() > 0.97
    assert found["score"].between(0, 1).all() and ((found["score"] >= 0.5) == (found["predicted"] == 1)).all()


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(k, "good words in a row here " * 3 if k % 2 else "#$ #$ #$ " * 9, 1, "x") for k in range(60)] + [(None, None, 0, ""), (1, "", 0, ""), (1, "", 0, "")], "doc_id long, text string, quality int, score string")
    labels = spark.createDataFrame([(k, k % 2, 0, "t") for k in range(60)] + [(3, None, 0, ""), (None, 1, 0, ""), (5, 7, 0, "")], "doc_id long, quality int, toxic int, text string")
    rows = quality_trees.quality(docs, quality_trees.fit(docs, labels)).collect()
    assert len(rows) == 63 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_trees.quality(docs.limit(0), quality_trees.fit(docs.limit(0), labels)).count() == 0
    assert {r["score"] for r in quality_trees.quality(docs, quality_trees.fit(docs, labels.limit(0))).collect()} == {0.5}


# whitening


def brute(vectors, components=16, copies=False):
    x = np.floor(64 * np.asarray(vectors, float)).astype(int) + 1_000_000
    distinct, times = np.unique(x, axis=0, return_counts=True)
    w = times if copies else np.ones(len(distinct), int)
    n, sums = int(w.sum()), (distinct * w[:, None]).sum(axis=0)
    centred = distinct - sums / n
    values, vectors_ = np.linalg.eigh((centred * w[:, None]).T @ centred / n)
    values, vectors_ = values[::-1][:components], vectors_[:, ::-1][:, :components]
    return n, [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x], (x - sums / n) @ vectors_ / np.sqrt(values), values / np.trace((centred * w[:, None]).T @ centred / n)


@pytest.mark.parametrize("weight", ["one", "copies"])
def test_whitening_equals_the_whole_matrix(spark, weight):
    draw = np.random.default_rng(7)
    base = draw.normal(size=(150, 20)) * np.linspace(0.2, 3, 20)
    vectors = [*base.tolist(), *[base[0].tolist()] * 200, *[base[1].tolist()] * 3]
    bad = [None, [1.0] * 3, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [None] + [0.0] * 19, []]
    frame = spark.createDataFrame([(k, v, 1, 2.0, "x") for k, v in enumerate([*vectors, *bad])], "vec_id long, embedding array<double>, n int, whitened double, key string").repartition(5)
    found = whitening.whiten(frame, weight=weight).toPandas()
    n, deviations, whitened, explained = brute(vectors, copies=weight == "copies")
    assert len(found) == 16 * len(vectors) and set(found["n"]) == {n} and found["identity_error"].max() < 1e-10
    wide = found.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    for c in range(16):
        assert min(np.abs(wide[:, c] - whitened[:, c]).max(), np.abs(wide[:, c] + whitened[:, c]).max()) < 1e-8
    assert found[found["component"] == 1].sort_values("vec_id")["deviation"].tolist() == deviations
    assert found.sort_values("component")["explained"].unique() == pytest.approx(explained)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id string, embedding array<float>"
    few = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema))
    assert few([]).count() == 0 and few([("a", None), ("b", [])]).count() == 0
    assert few([("a", [1.0, 2.0]), ("b", [1.0, 2.0])]).count() == 0  # one distinct vector has no variance
    rows = few([("a", [1.0, 5.0, 0.0]), ("a", [1.0, 5.0, 0.0]), (None, [3.0, 5.0, 0.0]), ("c", [2.0, 5.0, 1.0])]).toPandas()
    assert len(rows) == 4 * 2 and rows["n"].unique() == [3]  # the constant dimension leaves two components
    assert isinstance(rows, pd.DataFrame) and rows["vec_id"].isna().sum() == 2


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(10**9, np.array([10**15]), np.ones((1, 1)), np.ones(1), 1.0)
    assert model.deviations(np.array([[10**6 + 10**4], [10**6 + 1]])) == [None, 10**18]
