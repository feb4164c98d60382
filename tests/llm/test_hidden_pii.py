"""Spans that no fixed pattern finds: phones in pairs and spelled e-mails; and copied regions, which count once in the sample."""

import random

import pytest

from tallyfield.llm import pii

HIDDEN = [("phone", "06 12 34 56 78"), ("phone", "12 34 56 78"), ("email", "joe at example dot com"), ("email", "mary.x{at}example.com"), ("email", "bob [ at ] example [dot] org"), ("email", "ann [at] mail.example.net")]


def rows():
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("aeilnorst", k=draw.randint(2, 8)))
    number = lambda: f"+{draw.randrange(1, 60)} ({draw.randrange(100, 999)}) {draw.randrange(100, 999)}-{draw.randrange(1000, 9999)}"
    out = []
    for i in range(60):
        gap = lambda: " ".join(word() for _ in range(12))
        out.append((i, f"{gap()} {number()} {gap()} {word()}{draw.choice(['', '.', '_'])}{i}@mail{i % 9}.example.com {gap()} {draw.randrange(10**draw.randrange(4, 12))} {gap()}"))
    return out


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.createDataFrame(rows(), "doc_id long, text string"), 120)


@pytest.mark.parametrize("kind, span", HIDDEN)
def test_hidden_spans_are_added(field, kind, span):
    text = f"please write to them or call {span} before noon"
    text = text if kind == "phone" else text.replace("or call", "or mail to")
    at = text.index(span)
    assert field.added(text, pii.base_spans(text)) == [(kind, at, at + len(span))]
    assert pii.mask(text, [(kind, at, at + len(span))]).count("<") == 1


def test_plain_numbers_are_not_added(field):
    for text in ("we met on 2021-07-19 at 09:45 there", "we met at ten and the dot was red", "it was 14.02.2019 then"):
        assert field.added(text, pii.base_spans(text)) == []


def test_copies_count_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "train", lambda examples: seen.extend(t for t, _ in examples) or pii.Field({}))
    copies = [(1000 + i, "call +1 (826) 555-4081 now") for i in range(500)]
    pii.fit(spark.createDataFrame(rows() + copies, "doc_id long, text string").repartition(4), 100)
    assert seen.count("call +1 (826) 555-4081 now") <= 1 and len(set(seen)) > 50
