"""The text operators against plain loops, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyfield.llm import common, compression, hosts, html_text, jaccard, language, packing, phrases, pii, token_file, toxicity
from tallyfield.llm.tokens import default_tokenizer, encoder
from tallyfield.session import scratch_path

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, score double, n_words long, kind string"


def words(n, seed, pool=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(pool)}" for _ in range(n)]


def corpus():
    base = words(120, 1)
    texts = [None, "", " \n\t", "A", "a b c", "A B C", " ".join(base), " ".join(base), " ".join(base[:60] + ["new"] + base[61:])]
    texts += [" ".join(base[:100] + words(20, 9)), "x  y   z \n\n a \tb", "<|endoftext|> 1.2.3.4 a@b.co", "no spaces " * 3000, "é" * 50_000, "🙂 ok\x1c\x1d ok"]
    texts += [" ".join(words(30 + i, i)) for i in range(20)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "left over text"), (6, " ".join(base))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 0.5, 7, "x") for i, t in corpus()], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_tokens_equal_the_library():
    e = encoder(default_tokenizer())
    for _, text in corpus():
        assert e.encode([text or ""])[0].tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_added_tokens_and_small_memos_equal_a_fresh_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    from tallyfield.llm import tokens

    fresh = Tokenizer.from_file(default_tokenizer())
    monkeypatch.setattr(tokens, "MEMO_BYTES", 500)
    e = tokens.Encoder(default_tokenizer())
    odd = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n\nb  c", "<|endoftext", "", " ", "Wörter  und\u2003mehr it's 12,5"]
    for text in [*odd, *[t or "" for _, t in corpus()], *odd]:
        assert e.encode([text, "next one"])[0].tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_packing(docs, empty):
    rows = packing.pack(docs, with_ids=True).collect()
    assert packing.pack(empty).count() == 0
    pieces, bins = Counter(), {}
    e = encoder(default_tokenizer())
    whole = {(i, tuple(e.encode([t or ""])[0].tolist() + [0])) for i, t in corpus()}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces[r["doc_id"]] += r["length"]
        assert any(i == r["doc_id"] and list(t[r["start"] : r["start"] + r["length"]]) == ids.tolist() for i, t in whole)
    assert pieces == Counter([x for i, t in corpus() for x in [i] * (len(e.encode([t or ""])[0]) + 1)])
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_cuts_fill_classes():
    for n in range(1024):
        parts = packing.cuts(n, 1024, 16)
        assert sum(p for p, _ in parts) == n and all(k * p <= 1024 for p, k in parts)


def test_language(spark, empty):
    draw = random.Random(3)
    make = lambda letters: " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(2, 9))) for _ in range(80))
    rows = [(i, make("abcdeaeou") if i % 2 else make("xyzwvkö"), "aa" if i % 2 else "bb", 0.1, 1, "x") for i in range(300)]
    rows += [(1000, None, "aa", 0.1, 1, "x"), (1001, "123 !!", None, 0.1, 1, "x"), (1002, "日本語" * 200, None, 0.1, 1, "x")]
    df = spark.createDataFrame(rows, DOCS)
    model = language.fit(df, sample=60)
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert all(got[i]["lang_pred"] == ("aa" if i % 2 else "bb") and not got[i]["rejected"] for i in range(300))
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["rejected"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert {r["doc_id"] for r in language.accepted(df, model).collect()} == set(range(300))
    assert language.identify(empty, language.fit(empty)).count() == 0


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def test_jaccard_components(spark, empty):
    rows = list(corpus())
    base = words(300, 77, 5000)
    for k in range(30):  # a group of near copies that drifts
        base = base.copy()
        base[k * 9] = f"edit{k}"
        rows.append((500 + k, " ".join(base)))
    df = spark.createDataFrame([(i, t, "en", 0.5, 7, "x") for i, t in rows], DOCS).repartition(4)
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    expected = Counter((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))
    assert Counter(map(tuple, jaccard.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect())) == expected
    assert jaccard.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100} | {k: v for k, v in got.items() if k == v}


def test_compression(docs, empty):
    white = "\x20\x09-\x0d"
    expected = []
    for i, text in corpus():
        w = re.findall(f"[^{white}]+", text or "")
        times = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {j + k for j, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if times[g] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(f"[^{white}]", x)]
        expected.append((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)))
    got = compression.quality(docs).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter(expected)
    assert compression.quality(empty).count() == 0
    noise = random.Random(1).randbytes(20_000).hex().encode()
    assert not compression.verdict(b"same line again\n" * 2000)[3] and not compression.verdict(bytes(random.Random(1).randbytes(20_000)))[3]
    assert compression.verdict(" ".join(words(3000, 5, 100_000)).encode())[3] and len(noise) == 40_000


@pytest.mark.parametrize("counts", [[5], [0, 3, 0], [1] * 9, [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144], [0, *[2**i for i in range(30)]]])
def test_code_lengths(counts):
    counts = np.array(counts)
    bits = token_file.code_lengths(counts, 8).astype(int)
    used = counts > 0
    assert (bits[used] > 0).all() and (bits[~used] == 0).all() and bits.max() <= 8
    assert sum(2.0 ** -bits[used]) <= 1
    draw = np.random.default_rng(0)
    ids = draw.choice(np.flatnonzero(used), 1000)
    codes = token_file.canonical_codes(bits.astype(np.uint8))
    data = token_file.encode_block(ids, codes, bits.astype(np.uint8))
    assert (token_file.decode_block(*data, len(ids), token_file.decode_table(bits.astype(np.uint8))) == ids).all()


def test_token_files(spark, docs, empty):
    e = encoder(default_tokenizer())
    rows = sorted(((i, e.encode([t or ""])[0].tolist() + [2]) for i, t in corpus()), key=lambda r: (r[0] is not None, r[0] or 0))
    folder = scratch_path(spark, "test-tokens")
    token_file.write_token_files(docs, folder, block_ids=2000)
    got = sorted(token_file.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert r["start"] == at and r["n_tokens"] == len(ids) and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        assert (r["doc_id"], ids.tolist()) in rows
        at += len(ids)
    folder = scratch_path(spark, "test-tokens")
    token_file.write_token_files(empty, folder)
    assert token_file.read_token_files(spark, folder).count() == 0


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><nav><a href="/a">Menu one</a></nav><div class="cookie-notice">Cookies</div>
<article><h1>Head &amp; line</h1><p><b>First   paragraph with a good number of words in it.<br><p>Second one, also with words, and a <a href="x">link</a> inside it.
<p>Short.</p><aside>Aside</aside><div class="comments"><p>Reader comment that is long enough to look like text, really.</p></div></article>
<form>Mail <input></form><footer>&copy; foot</footer><script>var a = "</p>";</script></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Head & line\nFirst paragraph with a good number of words in it.\nSecond one, also with words, and a link inside it.\nShort."
    plain = "<div><a href=1>a</a><a href=2>b</a></div>" + "<div>" + "many words in a row here " * 20 + "</div><div>" + "and again some more words " * 20 + "</div>" + "<ul>" + "<li><a href=3>x</a>" * 9 + "</ul>"
    assert html_text.main_text(plain).count("\n") == 1
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", PAGE, "x"), (3, "u", PAGE, "x"), (None, "u", "just text", "x"), (4, "u", "<p>" * 3000 + "deep", "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r["n_chars"] for r in got) == sorted([0, 0, *[len(html_text.main_text(PAGE))] * 2, 9, 4])


def test_hosts(spark):
    link = '<a href="{}">x</a>'
    rows = [(1, "http://good.org/x", link.format("http://fine.net/1"), "x"), (2, "https://Fine.NET/a?b#c", None, "x"), (3, "http://bad.example.org/es/1", "", "x"), (4, "http://near.net", link.format("//bad.example.org/es/1"), "x")]
    rows += [(5, None, None, "x"), (6, "no scheme", "", "x"), (7, "http://a.com/fr/1", "", "x"), (8, "http://x.example.org/en/12", "", "x"), (9, "ftp://lone.net?q", "", "x")]
    got = {r["page_id"]: tuple(r)[1:5] for r in hosts.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")).collect()}
    assert got[1] == ("good.org", "/x", "org/", "allow") and got[2] == ("fine.net", "/a", None, "allow")
    assert got[3] == ("bad.example.org", "/es/1", "example.org/es/", "block") and got[4] == ("near.net", "", None, "block")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("example.org/en/1", "block") and got[9][:2] == ("lone.net", "")
    assert hosts.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_propagation_against_dense(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "d", 3), ("d", "b", 1)]
    names = "abcd"
    m = np.zeros((4, 4))
    for s, d, n in edges:
        m[names.index(s), names.index(d)] = n
    out, back = m / m.sum(1, keepdims=True), (m / np.maximum(m.sum(0, keepdims=True), 1)).T
    seed = {"trust": np.array([0.75, 0, 0, 0]), "distrust": np.array([0, 0, 0, 0.25])}
    rank = {k: v.copy() for k, v in seed.items()}
    for _ in range(400):
        rank = {"trust": 0.15 * seed["trust"] + 0.85 * rank["trust"] @ out, "distrust": 0.15 * seed["distrust"] + 0.85 * rank["distrust"] @ back}
    got = hosts.propagated(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("a", "trust", 3.0), ("d", "distrust", 1.0)], "host string, kind string, weight double"), tolerance=1e-12).collect()
    assert len(got) == 4
    for r in got:
        i = names.index(r["host"])
        assert abs(r["trust"] - rank["trust"][i]) < 1e-9 and abs(r["distrust"] - rank["distrust"][i]) < 1e-9


def test_hot_hosts_are_looked_up_like_others(spark):
    rows = [(i, "http://hot.net/a") for i in range(900)] + [(i, f"http://h{i}.net/a") for i in range(900, 1200)] + [(i, None) for i in range(1200, 1600)]
    marked = hosts.judged(spark.createDataFrame(rows, "page_id long, url string"), hosts.RULES)
    ranks = spark.createDataFrame([("hot.net", 0.1, 0.5), ("h901.net", 0.0, 0.2), ("gone.net", 0.0, 0.3)], "host string, trust double, distrust double")
    got = {r["page_id"]: r["distrust"] for r in hosts.looked_up(marked, ranks).collect()}
    assert got == {i: 0.5 if i < 900 else 0.2 if i == 901 else None for i in range(1600)}


def test_toxicity(spark, empty):
    rows = [(i, " ".join(words(60, i) + (["nasty", "vile"] if i % 4 == 0 else [])), "en", 0.5, 7, "x") for i in range(800)]
    df = spark.createDataFrame([*rows, (9000, None, "en", 0.1, 1, "x"), (9001, "", None, 0.1, 1, "x")], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)] + [(3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, toxicity.fit(df, labels)).collect()}
    held = [i for i in range(800) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[9000]["score"] == got[9001]["score"] and 0 <= got[9000]["score"] < 0.5
    assert toxicity.toxicity(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_pii_patterns():
    draw = random.Random(4)
    for _ in range(3000):
        text = "".join(draw.choice("ab1234567890.@+- ()%é") for _ in range(draw.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000):
        pii.base_spans(long)


def test_pii_field(spark, empty):
    draw = random.Random(5)
    number = lambda: f"+1 ({draw.randrange(100, 999)}) 555-{draw.randrange(1000, 9999)}"
    rows = [(i, f"{' '.join(words(9, i))} {number()} {' '.join(words(5, -i))} u{i}@mail{i % 9}.example.com end {draw.randrange(10**15)}", "en", 0.5, 7, "x") for i in range(150)]
    rows += [(900, None, "en", 0.1, 1, "x"), (901, "write to joe [at] example.com or +1 (826) 555-4081 190.137.223.20", None, 0.1, 1, "x")]
    df = spark.createDataFrame(rows, DOCS)
    field = pii.fit(df)
    got = {r["doc_id"]: r for r in pii.find(df, field).collect()}
    assert got[900]["spans"] == "" and all(set(filter(None, r["base_spans"].split(","))) <= set(r["spans"].split(",")) for r in got.values())
    assert "ip:51:65" in got[901]["spans"]
    out = {r["doc_id"]: r for r in pii.masked(df, field).collect()}
    assert out[900]["text"] is None and "<EMAIL>" in out[0]["text"] and "@" not in out[0]["text"] and "<PHONE>" in out[0]["text"] and out[0]["lang"] == "en"
    assert pii.find(empty, pii.fit(empty)).count() == 0
    n, scored = 3, [(0, 2, "card", [], 0.7), (1, 3, "ip", [], -0.2), (2, 3, "ip", [], 1.1)]
    odds, total = pii.Field.marginals(n, scored)
    weights = {(): 1.0, (0,): np.exp(0.7), (1,): np.exp(-0.2), (2,): np.exp(1.1), (0, 2): np.exp(1.8)}
    assert abs(np.exp(total) - sum(weights.values())) < 1e-9 and abs(odds[2] - (weights[2,] + weights[0, 2]) / sum(weights.values())) < 1e-9


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


@pytest.mark.parametrize("a_pass", [50_000, 2])
def test_phrases(spark, a_pass, empty):
    long = words(200, 8)
    items = [(1, " ".join(long[20:45])), (2, "A, b!"), (3, None), (4, " ".join(long[40:52])), (4, " ".join(long[40:52])), (5, "..."), (None, " ".join(long[100:112])), (6, "ok")]
    rows = [*corpus(), (700, " ".join(long)), (701, " ".join(long[18:33]) + " x a B"), (702, " ".join(long[20:29]))]
    df = spark.createDataFrame([(i, t, "en", 0.5, 7, "x") for i, t in rows], DOCS).repartition(3)
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    expected = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for key, ids in windows.items():
            for a in range(len(w) - len(key) + 1):
                if tuple(w[a : a + len(key)]) == key:
                    hit.update(range(a, a + len(key)))
                    found |= ids
        expected.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    folder = scratch_path(spark, "test-index")
    phrases.build_index(df, folder)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in phrases.contamination(spark, folder, benchmark, items_a_pass=a_pass).collect()]
    assert Counter(got) == Counter(expected)
    near = {(r["doc_id"], r["item_id"]) for r in phrases.near_matches(spark, folder, benchmark, span=12, items_a_pass=a_pass).collect()}
    assert {(700, "1"), (700, "4")} <= near
    other = scratch_path(spark, "test-index")
    phrases.build_index(empty, other)
    assert phrases.contamination(spark, other, benchmark).count() == 0


def test_word_hashes():
    for _, text in corpus():
        raw = (text or "").encode()
        got, begin = common.word_hashes([raw, b"tail"], common.separators())
        plain = raw.split()
        assert begin.tolist() == [0, len(plain), len(plain) + 1]
        assert len(set(got[:-1].tolist())) == len(set(plain))
