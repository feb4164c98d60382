"""Token ids by the tokenizers library, with a memo per worker for byte-level BPE."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyfield.llm.common import process_cache

#: The split pattern of byte-level BPE, and Unicode white space.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0  -     　"

#: Bytes of chunks and ids remembered per worker, in each of two memos: a full one becomes the old one, from which chunks in use are taken over.
#: An entry counts its text, its ids and so many bytes for the objects around them.
MEMO_BYTES, ENTRY_BYTES = 64 << 20, 180
#: New pieces go to the model in texts of so many.
PIECES_AT_ONCE = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """``encode(texts)`` gives each text's ids, equal to ``Tokenizer.encode`` with ``add_special_tokens=False``.

    A byte-level BPE never joins across the start of a run of white space, so a text may be cut there and the ids of each
    chunk remembered. Texts with a space behind white space take a pattern for the cut, all others the plain split at spaces; new pieces of
    these go to the model side by side, and a token that begins with a space begins a piece. Any other kind of tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        before = parts.get("pre_tokenizer") or {}
        self.by_chunk = (
            parts["model"].get("type") == "BPE" and not parts.get("normalizer") and not parts["model"].get("ignore_merges")
            and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        )
        #: Texts that hold one of the file's added tokens go to the library whole.
        self.added = [t["content"] for t in parts.get("added_tokens") or [] if t["content"]]
        self.split = regex.compile(BYTE_LEVEL_SPLIT)
        self.chunk = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        #: A space behind white space is inside a run, where a text may not be cut.
        self.inside = [c + " " for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c)]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.room = MEMO_BYTES
        self.model = self.tokenizer.model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in kept]
        self.spelled_ids = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}
        #: The model on pieces in its own spelling, one per line, and that spelling of every byte.
        self.spelled = Tokenizer(self.tokenizer.model)
        self.spelled.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.spelling = np.array([10 if b == 10 else ord(self.letters[b]) for b in range(256)], "<u2")
        self.spaced = np.zeros(len(self.spelled_ids), bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(self.letters[32])]] = True

    def keep(self, chunk: str, ids: bytes) -> bytes:
        self.memo[chunk] = ids
        self.room -= len(chunk) + len(ids) + ENTRY_BYTES
        return ids

    def keep_all(self, entries: dict[str, bytes]) -> None:
        self.memo.update(entries)
        self.room -= sum(map(len, entries)) + sum(map(len, entries.values())) + ENTRY_BYTES * len(entries)

    def known(self, chunk: str) -> bytes | None:
        found = self.memo.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is not None:
                self.keep(chunk, found)
        return found

    def known_all(self, chunks: list[str]) -> list[bytes | None]:
        found = list(map(self.memo.get, chunks))
        if self.old:
            missing = [i for i, ids in enumerate(found) if ids is None]
            before = list(map(self.old.get, [chunks[i] for i in missing]))
            self.keep_all({chunks[i]: ids for i, ids in zip(missing, before, strict=True) if ids is not None})
            for i, ids in zip(missing, before, strict=True):
                found[i] = ids
        return found

    def piece(self, text: str) -> bytes:
        """Ids of one match of the split pattern; as a chunk it is its own only match, so both share the memos."""
        found = self.known(text)
        if found is None:
            if text.isascii() and text[1:].isalnum():
                spelled = text.replace(" ", self.letters[32])
            else:
                spelled = text.encode().decode("latin-1").translate(self.letters)
            found = self.keep(text, b"".join([self.spelled_ids[t.id] for t in self.model.tokenize(spelled)]))
        return found

    def remembered(self, chunk: str) -> bytes:
        found = self.known(chunk)
        if found is None:
            if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
                return self.piece(chunk)
            found = self.keep(chunk, b"".join(map(self.piece, self.split.findall(chunk))))
        return found

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of new chunks that begin with their only space: all are cut into pieces at once, and new pieces go to the model side by side.

        Only the pieces are remembered: a word comes back with another comma or stop, and more of them fit.
        """
        pieces = self.split.findall("".join(chunks))
        found = self.known_all(pieces)
        missing = [i for i, ids in enumerate(found) if ids is None]
        fresh: dict[str, bytes | None] = dict.fromkeys([pieces[i] for i in missing])
        fit = [p for p in fresh if p[0] == " " and "\n" not in p]
        for i in range(0, len(fit), PIECES_AT_ONCE):
            group = fit[i : i + PIECES_AT_ONCE]
            letters = "\n".join(group)
            spelled = self.spelling[np.frombuffer(letters.encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.spelled.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
            starts = (np.flatnonzero(self.spaced[ids]) * 4).tolist()
            if len(starts) == len(group):  # else the vocabulary lacks some letters, and :meth:`piece` takes one by one
                data = ids.tobytes()
                fresh.update(done := dict(zip(group, [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)], strict=True)))
                self.keep_all(done)
        for i in missing:
            ids = fresh[pieces[i]]
            found[i] = self.piece(pieces[i]) if ids is None else ids
        first = np.flatnonzero([p[0] == " " for p in pieces])
        if len(first) != len(chunks):
            return [self.remembered(c) for c in chunks]
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))[[*first, len(pieces)]].tolist()
        data = b"".join(found)
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_chunk:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.room < 0:
            self.old, self.memo, self.room = self.memo, {}, MEMO_BYTES
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if any(a in text for a in self.added):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            elif any(r in text for r in self.inside):
                out[i] = np.frombuffer(b"".join(map(self.remembered, self.chunk.findall(text))), "<u4")
            else:
                plain.append(i)
        if plain:
            for i, ids in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        first = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        spaced = [" " + w for w in distinct]
        blobs = self.known_all(spaced)
        new = [i for i, ids in enumerate(blobs) if ids is None]
        alone = [i for i in new if spaced[i][-1].isspace()]  # white space at an end would run into the next chunk
        for i in alone:
            blobs[i] = self.remembered(spaced[i])
        new = [i for i in new if blobs[i] is None]
        for i, ids in zip(new, self.learn([spaced[i] for i in new]), strict=True):
            blobs[i] = ids
        blobs += [self.remembered(distinct[w]) for w in which[first[:-1]].tolist()]
        which[first[:-1]] = len(distinct) + np.arange(len(texts))
        taken = pa.array(blobs, pa.large_binary()).take(pa.array(which))
        _, ends, flat = taken.buffers()
        ids = np.frombuffer(flat or b"", "<u4", int(np.frombuffer(ends, "<i8")[len(which)]) // 4)
        return np.split(ids, np.frombuffer(ends, "<i8")[first[1:-1]] // 4)


def encoder(path: str) -> Encoder:
    return process_cache(f"encoder:{path}", lambda: Encoder(path))
