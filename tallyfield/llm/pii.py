"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans the patterns miss."""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import column, mapped, native_id_type, table, texts
from tallyfield.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
#: Regions of text, those with the least hash, on which the field is fitted; half of them may hold no span.
SAMPLE = 400
LONGEST_TOKENS = 24
#: Spans are added if their probability, over all segmentations of their region, is at least this.
SURE = 0.9
ROUNDS, RATE, PENALTY = 30, 2.0, 1e-3
#: Numbers that are no personal data, for the field to learn beside the regions of the corpus.
COUNTER = ("on 2024-01-05 at 10:33 we met", "from 12.05.2023 to 30.11.2023 it was", "at 2023/11/30 08:15:00 the job", "rows 1 2 3 4 5 6 7 8 9 of it", "paid 1,234,567.89 for 1.200.300 of", "version 10.2.33 and 4.0.12.7.1 of", "in 1998, 2004, 2011 and 2019 they", "about 120000 of 3500000 people")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small_parts(address: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in address.split(".")))


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches, found from each @ outwards, so a long run without @ costs nothing."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            out.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind, then start."""
    out = emails(text)
    out += [("ip", *m.span()) for m in IP.finditer(text) if small_parts(m[0])]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 37 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
#: A dot as people spell it, and an @ in brackets, or as a word or itself before a name with such a dot.
DOT_WORD = r"(?:[ \t]{0,2}[\[({<][ \t]?(?:dot|\.)[ \t]?[\])}>][ \t]{0,2}|[ \t]{1,2}dot[ \t]{1,2})"
AT_FORMS = rf"[\[({{<][ \t]?at[ \t]?[\])}}>]|(?:(?<=[A-Za-z0-9])[ \t]{{1,2}}at[ \t]{{1,2}}|@)(?=[A-Za-z0-9-]{{1,63}}{DOT_WORD}[A-Za-z])"
AT_WORD = re.compile(AT_FORMS, re.IGNORECASE)
#: What makes a stretch of text worth a look: three digits in a row, six in separated groups, an @ or its spelled forms.
TRIGGER = re.compile(rf"[0-9]{{3}}|[0-9](?:[^\w\n]{{0,3}}[0-9]){{5}}|{AT_FORMS}|@", re.IGNORECASE)
#: Characters on either side of a trigger that belong to its region.
AROUND = 48
#: Lines of a region with more characters are scored as a stream.
LONG_LINE = 4000


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, joined where they overlap, and cut back to white space where there is some in their outer half."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.end() + AROUND // 2 <= out[-1][1]:
            continue
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        a = max(a, text.find(" ", a, a + AROUND // 2) + 1) if a else 0
        cut = text.rfind(" ", b - AROUND // 2, b) if b < len(text) else -1
        b = cut if cut > 0 else b
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def side(text: str, at: int) -> str:
    c = text[at] if 0 <= at < len(text) else ""
    return "end" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def span_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate span, of its edges and of the characters beside it."""
    span = text[start:end]
    digits = NOT_DIGIT.sub("", span)
    shape = re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)), re.sub(r"[^\W\d_]+", "a", re.sub(r"\s+", " ", span)))
    out = ["any", f"digits{min(len(digits), 20)}", f"left {side(text, start - 1)}", f"right {side(text, end)}", f"first {side(span, 0)}", f"last {side(span, len(span) - 1)}"]
    out.append(f"shape {shape}" if len(shape) <= 20 else "long shape")
    out += [f"has {c}" for c in "@+-.()_ " if c in span]
    at = AT_WORD.search(span)
    if at:
        lead, tail = span[: at.start()].rstrip(), re.sub(DOT_WORD, ".", span[at.end() :].strip(), flags=re.IGNORECASE)
        name = "space" if re.search(r"\s", lead) else "word"
        host = "space" if re.search(r"\s", tail) else "dot" if "." in tail else "word"
        cut = (start > 0 and text[start - 1] in LOCAL) or text[end : end + 1].isalnum() or (text[end : end + 1] in ("-", ".") and text[end + 1 : end + 2].isalnum())
        out += ["at word", f"name {name}", f"host {host}", f"hidden {name} {host} {'cut' if cut else 'whole'}"]
    elif digits and not any(c.isalpha() for c in span):
        cut = any(c.isdigit() for c in text[max(0, start - 2) : start] + text[end : end + 2])
        groups = " ".join(str(min(len(g), 9)) for g in NOT_DIGIT.split(span) if g)
        out.append(f"groups {groups if len(groups) <= 20 else 'many'} {'cut' if cut else 'whole'}")
    if any(c.isalpha() for c in span):
        out.append("letters")
    if 13 <= len(digits) <= 19:
        out.append(f"luhn {luhn(digits)}")
    if IP.fullmatch(span):
        out.append(f"octets {small_parts(span)}")
    return out


def token_bounds(text: str, begin: int, end: int) -> list[int]:
    return [m.start() for m in TOKEN.finditer(text, begin, end)] + [end]


def spans_from(text: str, bounds: list[int], i: int) -> Iterator[int]:
    """The tokens before which a span from token i on may end: see :func:`candidates`."""
    if not (text[bounds[i]].isalnum() or text[bounds[i]] in "+("):
        return
    for j in range(i + 1, min(len(bounds) - 1, i + LONGEST_TOKENS) + 1):
        if not text[bounds[j] - 1].isalnum():
            continue
        span = text[bounds[i] : bounds[j]]
        if "\n" in span or len(span) > 80:
            break
        hidden = bool(AT_WORD.search(span))
        if not hidden and any(map(str.isalpha, span)) and any(map(str.isspace, span)):
            continue
        if hidden or "@" in span or sum(map(str.isdigit, span)) >= 6:
            yield j


def candidates(text: str, begin: int, end: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Token bounds of a region, and the token ranges that may be a span: at most ``LONGEST_TOKENS`` long, from and to a letter, a digit, + or a
    bracket, with six digits or more, or with an @ or its
    spelled form. Letters and white space go together only around the spelled form."""
    bounds = token_bounds(text, begin, end)
    return bounds, [(i, j) for i in range(len(bounds) - 1) for j in spans_from(text, bounds, i)]


def lines(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """The region cut after its line ends, which no candidate crosses, so the pieces are independent of each other."""
    while begin < end:
        cut = text.find("\n", begin, end) + 1 or end
        yield begin, cut
        begin = cut


def log_sum(first: float, others: list[float]) -> float:
    if not others:
        return first
    top = max(first, *others)
    return top + math.log(math.exp(first - top) + sum(math.exp(x - top) for x in others))


class Field:
    """Weights by (kind, feature). Tokens outside of spans weigh nothing, so a span's score is its log-odds against them."""

    def __init__(self, weights: dict[tuple[str, str], float]):
        self.weights = weights

    def chart(self, text: str, begin: int, end: int) -> tuple[list[int], list[tuple[int, int, str, list[str], float]]]:
        bounds, ranges = candidates(text, begin, end)
        scored = []
        for i, j in ranges:
            features = span_features(text, bounds[i], bounds[j])
            for kind in KINDS:
                scored.append((i, j, kind, features, sum(self.weights.get((kind, f), 0.0) for f in features)))
        return bounds, scored

    @staticmethod
    def marginals(n: int, scored: list[tuple[int, int, str, list[str], float]]) -> tuple[list[float], float]:
        """The probability of each scored segment over all segmentations of n tokens, and the log of their total weight."""
        starts: dict[int, list[int]] = {}
        ends: dict[int, list[int]] = {}
        for k, (i, j, *_rest) in enumerate(scored):
            starts.setdefault(i, []).append(k)
            ends.setdefault(j, []).append(k)
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = log_sum(ahead[j - 1], [ahead[scored[k][0]] + scored[k][4] for k in ends.get(j, ())])
        for i in range(n - 1, -1, -1):
            behind[i] = log_sum(behind[i + 1], [behind[scored[k][1]] + scored[k][4] for k in starts.get(i, ())])
        return [math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[n])) for i, j, _, _, s in scored], ahead[n]

    def best(self, text: str, begin: int, end: int) -> list[tuple[Span, float]]:
        """The most likely segmentation's spans, boundaries and kinds chosen jointly, with their probabilities."""
        bounds, scored = self.chart(text, begin, end)
        if not scored or max(s for *_, s in scored) <= 0:
            return []
        n = len(bounds) - 1
        ends: dict[int, list[int]] = {}
        for k, segment in enumerate(scored):
            ends.setdefault(segment[1], []).append(k)
        value, back = [0.0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in ends.get(j, ()):
                if value[scored[k][0]] + scored[k][4] > value[j]:
                    value[j], back[j] = value[scored[k][0]] + scored[k][4], k
        odds, _ = self.marginals(n, scored)
        out, j = [], n
        while j:
            k = back[j]
            if k < 0:
                j -= 1
            else:
                i, _, kind, _, _ = scored[k]
                out.append(((kind, bounds[i], bounds[j]), odds[k]))
                j = i
        return out[::-1]

    def best_streamed(self, text: str, begin: int, end: int) -> list[tuple[Span, float]]:
        """As :meth:`best`, with a few numbers per token in place of all candidates; they are scored once in each direction."""
        bounds = token_bounds(text, begin, end)
        n = len(bounds) - 1

        def scores(i: int) -> Iterator[tuple[int, int, float]]:
            for j in spans_from(text, bounds, i):
                features = span_features(text, bounds[i], bounds[j])
                for k, kind in enumerate(KINDS):
                    yield j, k, sum(self.weights.get((kind, f), 0.0) for f in features)

        ahead, value, score = (array("d", bytes(8 * (n + 1))) for _ in range(3))
        length, which = array("b", bytes(n + 1)), array("b", bytes(n + 1))
        waiting: dict[int, tuple[list[float], float, int, int, float]] = {}
        for i in range(n + 1):
            sums, top, *chosen = waiting.pop(i, ([], -math.inf, 0, 0, 0.0))
            if i:
                ahead[i], value[i] = log_sum(ahead[i - 1], sums), value[i - 1]
                if top > value[i]:
                    value[i], length[i], which[i], score[i] = top, *chosen
            if i == n:
                break
            for j, k, s in scores(i):
                sums, top, *chosen = waiting.get(j, ([], -math.inf, 0, 0, 0.0))
                sums.append(ahead[i] + s)
                if value[i] + s > top:
                    top, chosen = value[i] + s, [j - i, k, s]
                waiting[j] = (sums, top, *chosen)
        if value[n] <= 0:
            return []
        behind = array("d", bytes(8 * (n + 1)))
        for i in range(n - 1, -1, -1):
            behind[i] = log_sum(behind[i + 1], [behind[j] + s for j, _, s in scores(i)])
        out, j = [], n
        while j:
            i = j - (length[j] or 1)
            if length[j]:
                out.append(((KINDS[which[j]], bounds[i], bounds[j]), math.exp(min(0.0, ahead[i] + score[j] + behind[j] - ahead[n]))))
            j = i
        return out[::-1]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Sure spans that touch no span of the patterns."""
        if not self.weights:
            return []
        out, taken = [], []  # taken: what the patterns cover, in order and apart
        for _, a, b in sorted(base, key=lambda s: s[1]):
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        for region in regions(text):
            for begin, end in lines(text, *region):
                find = self.best if end - begin <= LONG_LINE else self.best_streamed
                for span, p in find(text, begin, end):
                    before = bisect_left(taken, (span[2],)) - 1  # the last that begins before the span ends
                    if p >= SURE and (before < 0 or taken[before][1] <= span[1]):
                        out.append(span)
        return out


def rewritings(kind: str, old: str) -> list[str]:
    """Ways in which people hide or shorten such data."""
    if kind == "email":
        name, host = old.split("@", 1)
        spelled_host = " dot ".join(host.split("."))
        return [f"{name} [at] {host}", f"{name} at {spelled_host}", f"{name}{{at}}{host}", f"{name} [ at ] {host.replace('.', ' [dot] ')}"]
    if kind == "phone":
        digits = NOT_DIGIT.sub("", old)
        pairs = lambda d: [d[i : i + 2] for i in range(0, len(d), 2)]
        return [re.sub(r"^\+[0-9]+ ", "", old), " ".join(pairs("0" + digits[-9:])), " ".join(pairs(digits[-8:])), ".".join(pairs("0" + digits[-9:]))]
    return []


def variants(text: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """The region as it is, and with one span rewritten in each way people hide or shorten such data, so that the field learns more than the patterns."""
    out = [(text, spans)]
    for kind, a, b in spans:
        old = text[a:b]
        for new in rewritings(kind, old):
            if new == old:
                continue
            grown = len(new) - len(old)
            moved = [(k, x, y) if y <= a else (k, x + grown, y + grown) for k, x, y in spans if (k, x, y) == (kind, a, b) or y <= a or x >= b]
            moved = [(k, a, b + grown) if (k, x) == (kind, a + grown) else (k, x, y) for k, x, y in moved]
            out.append((text[:a] + new + text[b:], moved))
    return out


def train(examples: list[tuple[str, list[Span]]]) -> Field:
    """Weights by gradient ascent on the likelihood of the marked segmentations, with a quadratic penalty."""
    field = Field({})
    charts, names = [], {}
    for text, spans in examples:
        bounds, scored = field.chart(text, 0, len(text))
        if not scored:
            continue
        place = {b: i for i, b in enumerate(bounds)}
        gold = {(place.get(a), place.get(b), kind) for kind, a, b in spans}
        flat = [[names.setdefault((kind, f), len(names)) for f in features] for _, _, kind, features, _ in scored]
        charts.append((len(bounds) - 1, scored, flat, np.array([(i, j, kind) in gold for i, j, kind, _, _ in scored], float)))
    w, squares = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(ROUNDS):
        gradient = -PENALTY * w * max(1, len(charts))
        for n, scored, flat, gold in charts:
            now = [(i, j, kind, features, float(w[ids].sum())) for (i, j, kind, features, _), ids in zip(scored, flat, strict=True)]
            odds, _ = field.marginals(n, now)
            for ids, g, p in zip(flat, gold, odds, strict=True):
                if abs(g - p) > 1e-4:
                    gradient[ids] += g - p
        squares += gradient**2
        w += RATE * gradient / np.sqrt(squares)
    return Field({name: float(w[k]) for name, k in names.items() if abs(w[k]) > 1e-4})


def fit(documents: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` distinct regions of the corpus, marked by the fixed patterns, half of them with spans at most, and on variants of them."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts(batch, "text"):
            base = None
            for a, b in regions(text):
                base = base_spans(text) if base is None else base
                touching = [s for s in base if s[1] < b and s[2] > a]
                if b - a <= 400 and all(s[1] >= a and s[2] <= b for s in touching):
                    inside, last = [], -1
                    for k, x, y in sorted(touching, key=lambda s: s[1]):
                        if x >= last:
                            inside.append(f"{k}:{x - a}:{y - a}")
                            last = y
                    rows.append((text[a:b], ",".join(inside), bool(inside)))
        # equal regions count once; the least of a slice include all of it that can be among the least of the corpus
        ranked = sorted((hashlib.blake2b(repr(r).encode("utf-8", "surrogatepass"), digest_size=8).digest(), *r) for r in set(rows))
        rows = [r for side_ in (True, False) for r in [x for x in ranked if x[3] == side_][: sample // 2]]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.string(), pa.bool_()), strict=True)], ["draw", "region", "spans", "marked"])

    found = mapped(documents.select("text"), "text", make, "draw binary, region string, spans string, marked boolean")
    ranked = found.distinct()
    rows = [r for side_ in (True, False) for r in ranked.where(F.col("marked") == side_).orderBy("draw", "region").limit(sample // 2).collect()]
    examples = []
    for row in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row["spans"].split(",") if s)]
        examples += variants(row["region"], spans)
    if examples:
        examples += [(text, []) for text in COUNTER]
    return train(examples)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(documents: DataFrame, field: Field) -> DataFrame:
    """doc_id, base_spans, spans of every document as text: kind:start:end in code points, end exclusive, by kind, then start.

    Null text counts as empty and has no spans. Texts are read whole. Repeated rows give repeated results, an empty table none; other columns are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast(field.weights)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, base_out, all_out, counts = Field(held.value), [], [], []
        for text in texts(batch, "text"):
            base = base_spans(text)
            base_out.append(spelled(base))
            all_out.append(spelled(ordered(base + own.added(text, base))))
            counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
        numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
        return pa.record_batch([column(batch, "doc_id"), *numbers, pa.array(base_out), pa.array(all_out)], ["doc_id", *[f"n_{k}" for k in KINDS], "base_spans", "spans"])

    schema = f"doc_id {native_id_type(documents)}, {', '.join(f'n_{k} long' for k in KINDS)}, base_spans string, spans string"
    return mapped(documents.select("doc_id", "text"), "text", make, schema)


def mask(text: str, spans: list[Span]) -> str:
    """Every span gives way to its kind in angle brackets; spans that overlap give way together, to the kind of the first."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join(out) + text[last:]


def masked(documents: DataFrame, field: Field) -> DataFrame:
    """The rows, all columns kept, with spans masked in ``text``; ``n_chars``, if it is there, follows. Null text stays null."""
    held = documents.sparkSession.sparkContext.broadcast(field.weights)
    schema = documents.schema

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, out = Field(held.value), []
        for text in column(batch, "text").to_pylist():
            if text is not None:
                base = base_spans(text)
                spans = base + own.added(text, base)
                text = mask(text, spans) if spans else text
            out.append(text)
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        columns["text"] = pa.array(out, columns["text"].type)
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if n is None or t is None else len(t) for t, n in zip(out, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return mapped(documents, "text", make, schema)


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = find(documents, fit(documents))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")
