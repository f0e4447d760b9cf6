"""Token ids by a given tokenizer file, for use inside tasks.

Blanks end every pre-token of the tokenizers used here and have no ids themselves, so the ids of a
text are the ids of its parts in a row: blank-separated chunks, cut further where words meet signs
if the tokenizer parts them.  Parts repeat, so their ids are kept, by each Python worker for all its
tasks, and texts are cut, looked up and put together in arrays.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT = 1 << 19        # parts remembered in one Python worker: about 25 MB
LONGEST_KEPT = 64     # bytes
TOGETHER = 1 << 22    # bytes of texts looked through for new parts at once, at most twice as many
_JOINED = 2000        # new parts encoded at once
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"      # an apostrophe may begin a part of its own
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_ACCENTED = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
# kinds of bytes, told apart by the sum of two neighbours
_LETTER, _SIGN, _BLANK = 1, 2, 16


def _kinds(parted: bool) -> bytes:
    kinds = bytearray(256)
    for members, kind in ((_LETTERS + _LETTERS.upper(), _LETTER), (_SIGNS, _SIGN)) if parted else ():
        for byte in members:
            kinds[byte] = kind
    for byte in b" \t\n\v\f\r":
        kinds[byte] = _BLANK
    return bytes(kinds)


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        # parts remembered, their ids, and how many times texts were looked through since each was found
        self.parts = pa.array([], pa.large_string())
        self.told = pa.array([], pa.large_binary())
        self.older = np.zeros(0, dtype=np.int64)
        # where the tokenizer itself takes no notice of case, or parts words from signs, texts are
        # lower-cased and cut so
        word = _LETTERS.decode()
        normal, split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.caseless = normal is not None and normal.normalize_str(word.upper()) == word

        def pieces(text: str) -> list[str]:
            return [p for p, _ in split.pre_tokenize_str(text)]

        signs = [chr(s) * n for s in _SIGNS for n in (1, 2)] + [_SIGNS.decode()]
        self.parted = split is not None and all(
            pieces(f"Az{s} {s}az{s}Az") == ["Az", s, s, "az", s, "Az"] for s in signs)
        self.kinds = _kinds(self.parted)
        # letters as they reach the model, if the tokenizer changes none for its neighbours: words of
        # them need no normalizer and no splitting
        letters = word + _ACCENTED
        self.direct = {ord(a): "".join(pieces(a)) for a in letters} if split is not None else {}
        if self.direct and (pieces(f"{letters} a") != [letters.translate(self.direct), "a"]
                            or normal is not None and normal.normalize_str(letters) != letters):
            self.direct = {}
        # a text with one of these is not cut: its ids may cross the cuts
        added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = [a.lower() for a in added] if self.caseless else added

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _joined(self, parts: list[str]) -> Iterator[bytes]:
        """Encode parts together, which costs less than one by one, and cut at their bounds."""
        for at in range(0, len(parts), _JOINED):
            texts = parts[at:at + _JOINED]
            told = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            data = np.array(told.ids, dtype="<u4").tobytes()
            ends = np.cumsum([len(t) + 1 for t in texts])
            cut = [0, *(4 * np.searchsorted([o[0] for o in told.offsets], ends)).tolist()]
            yield from map(data.__getitem__, map(slice, cut, cut[1:]))

    def _learn(self, new: list[bytes]) -> None:
        """Remember the ids of parts, behind those remembered before."""
        known, tokens = frozenset(map(chr, self.direct)), self.tokenizer.model.tokenize
        texts = [p.decode() for p in new]
        words = list(map(known.issuperset, texts))
        others = self._joined([t for t, word in zip(texts, words) if not word])
        told = [b"".join([t.id.to_bytes(4, "little") for t in tokens(text.translate(self.direct))]) if word
                else next(others) for text, word in zip(texts, words)]
        self.told = pa.concat_arrays([self.told, pa.array(told, pa.large_binary())])

    def _forget(self) -> None:
        """Long parts go, and those not found for longest if too many are remembered."""
        kept = np.flatnonzero(pc.binary_length(self.parts).to_numpy() <= LONGEST_KEPT)
        if len(kept) > KEPT:
            kept = np.sort(kept[np.argsort(self.older[kept], kind="stable")[:KEPT // 2]])
        if len(kept) < len(self.parts):
            self.parts, self.told = self.parts.take(pa.array(kept)), self.told.take(pa.array(kept))
            self.older = self.older[kept]

    def _cut(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Where the parts of texts begin and end, runs of blanks among them."""
        kinds = np.frombuffer(data.translate(self.kinds), dtype=np.uint8)
        both = kinds[:-1] + kinds[1:]
        cut = np.ones(len(kinds) + 1, dtype=bool)
        cut[1:-1] = (both == _LETTER + _SIGN) | (both // _BLANK == 1)
        cut[offsets] = True
        return np.flatnonzero(cut)

    def _ids(self, parts: pa.Array) -> pa.Array:
        """Ids of each part."""
        # parts remembered stand in front, so that their numbers are their places
        found = pa.concat_arrays([self.parts, parts]).dictionary_encode()
        code = found.indices[len(self.parts):]
        new = found.dictionary[len(self.parts):]
        self._learn(new.cast(pa.large_binary()).to_pylist())
        self.parts = found.dictionary
        self.older = np.append(self.older + 1, np.zeros(len(new), dtype=np.int64))
        self.older[code.to_numpy()] = 0
        ids = self.told.take(code)
        self._forget()
        return ids

    def encode(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """Ids of each text; none may be null."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        done = 0
        while done < len(column):
            before = ends[done - 1] if done else 0
            many = len(column)
            if ends[-1] - before >= 2 * TOGETHER:
                many = int(np.searchsorted(ends, before + TOGETHER)) + 1
            yield from self._encode(column[done:many])
            done = many

    def _encode(self, column: pa.Array) -> Iterator[bytes]:
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = (column.buffers()[2] or pa.py_buffer(b""))[offsets[0]:offsets[-1]].to_pybytes()
        offsets = offsets - offsets[0]
        if not data:
            yield from [b""] * len(column)
            return
        if self.caseless:
            data = data.lower()
        at = self._cut(data, offsets)
        ids = self._ids(pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)))
        low, row = np.frombuffer(ids.buffers()[1], dtype=np.int64)[:len(at)], ids.buffers()[2]
        cut = low[np.searchsorted(at, offsets)].tolist()
        added = [a for a in self.added if a in data]
        for number in range(len(column)):
            if added and any(a in data[offsets[number]:offsets[number + 1]] for a in added):
                yield self._alone(column[number].as_py())
            else:
                yield row[cut[number]:cut[number + 1]].to_pybytes()


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until there is enough for ``Encoder.encode`` to look through at once."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.nbytes for b in waiting) >= TOGETHER:
            yield pa.concat_batches(waiting)
            waiting = []
    if waiting:
        yield pa.concat_batches(waiting)


def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker.

    Functions travel to tasks by value, with new globals each time; only what is among the worker's
    modules stays.
    """
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
