"""Texts without repetitions are rejected by the upper limits, whole or in part; prose is not."""

import base64
import random
import string

import pytest

from tallyfield.llm import compression

LONG = (4097, 6000, 12_000, 20_000, 100_000, 1_000_000)


def spaced(alphabet, n, draw):
    return " ".join("".join(draw.choices(alphabet, k=draw.randint(3, 9))) for _ in range(n // 4 + 1))[:n].encode()


def noise(kind, n):
    draw = random.Random(n)
    if kind == "base64":
        return base64.encodebytes(draw.randbytes(n))[:n]
    if kind == "hex":
        return draw.randbytes(n).hex().encode()[:n]
    if kind == "hex words":
        return b" ".join(draw.randbytes(4).hex().encode() for _ in range(n // 9 + 1))[:n]
    return spaced(string.ascii_lowercase if kind == "letters" else string.ascii_letters + string.digits, n, draw)


def prose(n):
    draw = random.Random(n)
    syllables = [a + b for a in "bdfglmnprst" for b in ("a", "en", "er", "i", "ou")]
    pool = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(3000)]
    return " ".join(pool[int(3000 * draw.random() ** 3)] for _ in range(n))[:n].encode()


@pytest.mark.parametrize("kind, lengths", [("base64", (600, 1500, 3000, *LONG)), ("alnum", (1500, 3000, *LONG)), ("hex", (3500, *LONG)), ("hex words", (3500, *LONG)), ("letters", (3500, *LONG))])
def test_noise_is_rejected(kind, lengths):
    assert [n for n in lengths if compression.verdict(noise(kind, n))[3]] == []


def test_prose_is_kept():
    assert all(compression.verdict(prose(n))[3] for n in (300, 700, 1500, 3500, *LONG))
    cyrillic = prose(60_000).decode().translate({i + 97: chr(0x430 + i) for i in range(26)}).encode()
    assert all(compression.verdict(cyrillic[:n])[3] for n in (700, 1500, 3500, *LONG[:4]))


def test_last_partial_chunk_counts():
    text = prose(4096) + noise("base64", 4000)
    assert compression.verdict(text)[1:3] == (1, 2)
    assert compression.verdict(prose(4096) + b"short end")[1:3] == (0, 1)
