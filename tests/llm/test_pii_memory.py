"""Long numeric texts in bounded memory, with the same spans as the chart of all candidates."""

import random
import tracemalloc

from tallyfield.llm import pii

WEIGHTS = {("phone", "any"): -9.0, ("phone", "left space"): 3.0, ("phone", "right space"): 3.0, ("phone", "shape 3-4"): 9.0, ("phone", "digits7"): 1.0, ("card", "any"): -7.0, ("card", "digits12"): 6.5, ("email", "any"): -9.0, ("ip", "any"): -9.0}


def numbers(n, seed, ends=" "):
    draw = random.Random(seed)
    return "".join(f"{draw.randrange(10 ** draw.randint(2, 7))}{draw.choice(['', '', '-' + str(draw.randrange(1000, 9999))])}{draw.choice(ends)}" for _ in range(n))


def test_streamed_equals_chart():
    field = pii.Field(WEIGHTS)
    for seed in range(6):
        text = numbers(120, seed)
        one, other = field.best(text, 0, len(text)), field.best_streamed(text, 0, len(text))
        assert [s for s, _ in one] == [s for s, _ in other] and one
        assert all(abs(p - q) < 1e-9 for (_, p), (_, q) in zip(one, other, strict=True))


def test_lines_change_nothing():
    field = pii.Field(WEIGHTS)
    text = numbers(200, 9, " \n")
    whole = [s for s, p in field.best(text, 0, len(text)) if p >= pii.SURE]
    assert whole and field.added(text, []) == whole


def test_memory_of_long_numbers():
    field = pii.Field(WEIGHTS)
    for ends in (" ", " \n"):
        text = numbers(800, 3, ends)
        tracemalloc.start()
        field.added(text, [])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 4_000_000
