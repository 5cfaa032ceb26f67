"""Whole-text encoding by tokenizers that drop white space.

Such a tokenizer splits at white space before anything else, so a text's ids are those of
its space-separated words, one after the other. A worker keeps the ids of the words it has
met and asks the library for new ones, many at a time. The ids are those of
`Tokenizer.encode(text, add_special_tokens=False)`; a tokenizer of another kind encodes
each text whole.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import byte_table, text_bytes

#: What may stand behind a word of letters and is encoded apart from it.
STOPS = ".,;:!?"
#: Words handed to the library at once.
TOGETHER = 4096


def splits_at_space(tokenizer) -> bool:  # noqa: ANN001
    """White space separates: it yields no ids, and words at both sides encode as they do alone."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    probes = ("a", "The", "x.", "'s", "7", "é", "日", "́")
    return not ids(" \n ") and all(ids(f"{a} {b}\n{a}") == ids(a) + ids(b) + ids(a) for a in probes for b in probes)


class WordEncoder:
    """Encodes texts into unsigned 32-bit ids. `most` bounds the words that are remembered."""

    def __init__(self, path: str, most: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks keep the cores busy
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.cuts = splits_at_space(self.tok)
        #: Does the tokenizer lower A to Z itself? Then words are remembered in lower case.
        self.lowers = all(self.tok.encode(c, add_special_tokens=False).ids == self.tok.encode(c.lower(), add_special_tokens=False).ids for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        self.most, self.known = most, {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        ends = list(itertools.accumulate(len(x) * 4 for x in ids))
        raw = np.fromiter(itertools.chain.from_iterable(ids), "<u4", ends[-1] // 4 if ends else 0).tobytes()
        return [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        heads = {w: h for w in words if (h := w.rstrip(STOPS)) != w and h.isalpha()}
        new = [*{w for w in words if w not in heads} | {x for w, h in heads.items() for x in (h, w[len(h) :]) if x not in self.known}]
        out: dict[str, bytes] = {}
        for lo in range(0, len(new), TOGETHER):
            out.update(zip(new[lo : lo + TOGETHER], self._plain(new[lo : lo + TOGETHER]), strict=True))
        for w, h in heads.items():
            tail = w[len(h) :]
            out[w] = (out[h] if h in out else self.known[h]) + (out[tail] if tail in out else self.known[tail])
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        out = list(map(self.known.get, words))
        if None in out:
            new = self._learn([w for w, x in zip(words, out, strict=True) if x is None])
            out = [new[w] if x is None else x for w, x in zip(words, out, strict=True)]
            if len(self.known) + len(new) <= self.most:  # when full, what came first, so the frequent words, stays
                self.known.update(new)
        return out

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each text's closed by end_id, and their n + 1 bounds; null is empty."""
        texts = column.fill_null("").cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if self.cuts:
            if self.lowers:  # byte by byte, which also holds for slices of a column
                data, offs = text_bytes(texts)
                lower = byte_table("space")[0][data]
                texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(lower))
            words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            coded = words.flatten().dictionary_encode()
            ids = pa.array(self._ids(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
            at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
            flat = np.frombuffer(ids.buffers()[2], "<u4", int(at[-1]) // 4) if at[-1] else np.zeros(0, "<u4")
            bounds = at[np.asarray(words.offsets)] // 4
        else:
            own = self._plain(texts.to_pylist())
            flat, bounds = np.frombuffer(b"".join(own), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in own])])
        sizes = np.diff(bounds)
        closed = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.full(closed[-1], end_id, "<u4")
        inner = np.ones(len(out), bool)
        inner[closed[1:] - 1] = False
        out[inner] = flat
        return out, closed


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)
