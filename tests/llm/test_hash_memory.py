"""Word hashes in bounded memory, the same wherever a run of words is cut."""

import tracemalloc

from tallyfield.llm import common


def test_memory_of_word_hashes():
    texts = [b"some words of a longer text " * 1000] * 150  # 4.2 MB
    tracemalloc.start()
    words, begin = common.word_hashes(texts, common.separators())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 150 * 6000 and begin[-1] == len(words)
    assert peak < 80_000_000


def test_runs_change_nothing(monkeypatch):
    texts = [b"", b"a bc  def\n ghij", b"x" * 300, b"one two " * 40]
    whole = common.word_hashes(texts, common.separators())
    for size in (1, 7, 64):
        monkeypatch.setattr(common, "HASH_BYTES", size)
        cut = common.word_hashes(texts, common.separators())
        assert cut[0].tolist() == whole[0].tolist() and cut[1].tolist() == whole[1].tolist()
