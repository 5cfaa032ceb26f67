"""Whole-text encoding by the public tokenizers library inside Spark tasks.

Prose repeats its words, so each worker keeps the ids of the space-led pieces
it has met and asks the library only for new ones, many at a time. A slice's
pieces are looked up together, as numbers, and none becomes a Python string.
Texts with unusual white space are encoded by the library as they are. Both ways
give the ids of `Tokenizer.encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix, text_bytes

STOPS = ".,;:!?"
#: Words that the library gets as one text, and the byte-level sign of a space.
TOGETHER, SPACE = 64, "Ġ"
#: Marks a word that begins a line.
FIRST = "\x01"
#: White space that isn't one space or line end between two other characters, or the mark itself.
ODD = r"[\s\pZ\x00-\x1f\x7f-\x{a0}]{2}|^[\s\pZ\x00-\x1f\x7f-\x{a0}]|[\s\pZ\x00-\x1f\x7f-\x{a0}]$|\x01"


#: Words of 8 bytes that hold a piece and, in the last byte, its length; longer pieces are not remembered.
WORDS = 4
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def default_tokenizer() -> str:
    """Where the public tokenizers keep the vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memory:
    """Ids of short pieces by their bytes. Pieces lie in the order of a hash; all their bytes are compared, so the hash decides nothing."""

    def __init__(self, most: int) -> None:
        self.most, self.hashes, self.keys, self.rows = most, np.zeros(0, np.uint64), np.zeros((WORDS, 0), np.uint64), np.zeros(0, np.int64)
        self.ids = pa.array([], pa.large_binary())

    def keyed(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each piece's key and hash, and whether it is short enough."""
        data, offs = text_bytes(pieces)
        sizes = np.diff(offs)
        raw = np.concatenate([data, np.zeros(8 * WORDS, np.uint8)])
        at_byte = np.ndarray(len(data) + 8 * WORDS - 7, "<u8", raw, strides=(1,))
        keys, hashes = np.empty((WORDS, len(sizes)), np.uint64), np.zeros(len(sizes), np.uint64)
        for k in range(WORDS):
            keys[k] = at_byte[offs[:-1] + 8 * k] & _BELOW[np.clip(sizes - 8 * k, 0, 8)]
            if k == WORDS - 1:
                keys[k] |= sizes.astype(np.uint64) << np.uint64(56)
            hashes += keys[k] * np.uint64(_ODDS[k])
        return keys, mix(hashes), sizes < 8 * WORDS

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The row of each piece in ids; -1 for an unknown one."""
        if not len(self.hashes) or not len(pieces):
            return np.full(len(pieces), -1)
        keys, hashes, short = self.keyed(pieces)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        for mine, theirs in zip(self.keys, keys, strict=True):
            short &= mine[at] == theirs
        return np.where(short, self.rows[at], -1)

    def add(self, pieces: pa.Array, ids: pa.Array) -> None:
        """Keep unknown pieces while there is room: what came first, so the frequent ones, stays."""
        room = self.most - len(self.hashes)
        if room <= 0:
            return
        keys, hashes, short = self.keyed(pieces)
        near = np.searchsorted(self.hashes, hashes)
        free = short & ((near == len(self.hashes)) | (np.append(self.hashes, np.uint64(0))[near] != hashes))
        new = np.flatnonzero(free)
        new = new[np.sort(np.unique(hashes[new], return_index=True)[1])][:room]
        joined = np.concatenate([self.hashes, hashes[new]])
        order = np.argsort(joined, kind="stable")
        self.hashes, self.keys = joined[order], np.concatenate([self.keys, keys[:, new]], axis=1)[:, order]
        self.rows = np.concatenate([self.rows, len(self.ids) + np.arange(len(new))])[order]
        self.ids = pa.concat_arrays([self.ids, ids.take(pa.array(new))])


class Encoder:
    """Encodes texts into arrays of unsigned ids. `most` bounds the pieces that are remembered."""

    def __init__(self, path: str, most: int = 450_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Sequence

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        #: A byte-level splitter with its pattern and without a prefix space cuts before a single inner space and around a single line end.
        self.cuts = isinstance(self.tok.pre_tokenizer, ByteLevel) and self.tok.pre_tokenizer.use_regex and not self.tok.pre_tokenizer.add_prefix_space and self.tok.normalizer is None
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.cuts &= len(line) == 1  # else nothing marks where lines begin
        self.line_end = line[0] if line else 0
        #: ASCII letters are their own byte-level signs, and the splitter cuts a text of such words where the spaces are. If no
        #: token of ASCII signs goes on across a space, merging the whole text at once gives the ids of its words.
        merges = isinstance(model := self.tok.model, BPE) and not (model.ignore_merges or model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
        merges = merges and all(t.special for t in self.tok.get_added_tokens_decoder().values())
        apart = all(not t.replace(SPACE, "").isascii() for t in self.tok.get_vocab() if SPACE in t.lstrip(SPACE))
        self.bare = Tokenizer.from_file(path) if self.cuts and merges and apart else None
        if self.bare is not None:
            self.bare.encode_special_tokens, self.bare.pre_tokenizer = True, Sequence([])
        self.wide = np.dtype("<u2") if self.tok.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.known = Memory(most)
        #: Ids whose token begins with a space: the first of each space-led word.
        self.led = np.array([(self.tok.id_to_token(i) or "").startswith(SPACE) for i in range(self.tok.get_vocab_size())])

    def _plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.wide).tobytes()

    def _together(self, words: pa.Array, lead: str) -> pa.Array:
        """Ids of words behind a space (SPACE: of ASCII letters, for the bare model) or a line end: many encoded as one text, cut at what leads each."""
        if not len(words):
            return pa.array([], pa.large_binary())
        tok = self.bare if lead == SPACE else self.tok
        bounds = [*range(0, len(words), TOGETHER), len(words)]
        parts, begins, total = [], [], 0
        data, offs = text_bytes(pc.binary_join_element_wise(pa.scalar(lead, pa.large_string()), words, pa.scalar("", pa.large_string())))
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            text = data[offs[lo] : offs[hi]].tobytes().decode()
            ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.wide)
            at = np.flatnonzero(ids == self.line_end if lead == "\n" else self.led[ids])
            if len(at) != hi - lo:
                own = [np.frombuffer(self._plain(w if lead == "\n" else " " + w), self.wide) for w in words.slice(lo, hi - lo).to_pylist()]
                ids, at = np.concatenate(own), np.cumsum([0, *map(len, own)])[:-1]
            elif lead == "\n":  # line ends go
                ids, at = ids[ids != self.line_end], at - np.arange(len(at))
            parts.append(ids)
            begins.append(at + total)
            total += len(ids)
        offs = np.concatenate([*begins, [total]]).astype(np.int64) * self.wide.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offs), pa.py_buffer(np.concatenate(parts))])

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of pieces, each as a whole."""
        kind = np.zeros(len(words), np.int8)
        if self.bare is not None:
            kind[np.asarray(pc.ascii_is_alpha(words))] = 1
        kind[np.asarray(pc.starts_with(words, FIRST))] = 2
        kind[np.asarray(pc.equal(words, "\n"))] = 3
        at = [np.flatnonzero(kind == k) for k in range(4)]
        some = [words.take(pa.array(x)) for x in at]
        ids = [self._together(some[0], " "), self._together(some[1], SPACE), self._together(pc.utf8_slice_codeunits(some[2], 1), "\n"), pa.array([self._plain("\n")] * len(some[3]), pa.large_binary())]
        return pa.concat_arrays(ids).take(pa.array(np.argsort(np.concatenate(at))))

    def _learn(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Names and ids of distinct pieces not yet known, then of new words in them. A letters-only word and the stops behind it encode apart."""
        heads = pc.utf8_rtrim(pieces, STOPS)
        apart = np.asarray(pc.and_(pc.not_equal(pc.binary_length(heads), pc.binary_length(pieces)), pc.utf8_is_alpha(heads)))
        whole, cut = pa.array(np.flatnonzero(~apart)), pa.array(np.flatnonzero(apart))
        coded = heads.take(cut).dictionary_encode()
        at = self.known.find(coded.dictionary)
        new = np.flatnonzero(at < 0)
        words = pa.concat_arrays([pieces.take(whole), coded.dictionary.take(pa.array(new))]).dictionary_encode()  # a new head may be a piece too
        own = self._words(words.dictionary)
        ids = own.take(words.indices)
        at[new] = len(self.known.ids) + len(whole) + np.arange(len(new))
        led = pa.concat_arrays([self.known.ids, ids]).take(pa.array(at)).take(coded.indices)
        ends = pc.extract_regex(pieces.take(cut), f"(?P<end>[{STOPS}]+)$").field("end").dictionary_encode()
        tails = pa.array(map(self._plain, ends.dictionary.to_pylist()), pa.large_binary()).take(ends.indices)
        closed = pc.binary_join_element_wise(led, tails, pa.scalar(b"", pa.large_binary()))
        ids = pa.concat_arrays([ids.slice(0, len(whole)), closed]).take(pa.array(np.argsort(np.concatenate([whole, cut]))))
        return pa.concat_arrays([pieces, words.dictionary.slice(len(whole))]), pa.concat_arrays([ids, own.slice(len(whole))])

    def _ids(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces: a word behind a space, a line end, or FIRST and a word that begins a line."""
        at = self.known.find(pieces)
        gaps = np.flatnonzero(at < 0)
        if not len(gaps):
            return self.known.ids.take(pa.array(at))
        names, ids = self._learn(pieces.take(pa.array(gaps)))
        at[gaps] = len(self.known.ids) + np.arange(len(gaps))
        out = pa.concat_arrays([self.known.ids, ids]).take(pa.array(at))
        self.known.add(names, ids)
        return out

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column end to end, each text's closed by end_id, and their n + 1 bounds; null is empty."""
        texts = column.fill_null("").cast(pa.large_string())
        if self.cuts:
            odd = pc.or_(pc.match_substring_regex(texts, ODD), pc.equal(pc.binary_length(texts), 0))
        else:
            odd = pa.array([True] * len(texts), pa.bool_())
        plain = pc.if_else(odd, pa.scalar("a", pa.large_string()), texts)
        lines = pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), pc.replace_substring(plain, "\n", f" \n {FIRST}"), pa.scalar("", pa.large_string()))
        words = pc.split_pattern(lines, " ")
        coded = words.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        flat = np.frombuffer(ids.buffers()[2], self.wide, int(at[-1]) // self.wide.itemsize) if len(ids) else np.zeros(0, self.wide)
        bounds = at[np.asarray(words.offsets)] // self.wide.itemsize
        strange = np.flatnonzero(np.asarray(odd)).tolist()
        own = {i: np.frombuffer(self._plain(texts[i].as_py()), self.wide) for i in strange}
        sizes = np.diff(bounds)
        sizes[strange] = [len(own[i]) for i in strange]
        closed = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.full(closed[-1], end_id, np.dtype("<u4"))
        if strange:
            for i in range(len(texts)):
                out[closed[i] : closed[i + 1] - 1] = own[i] if i in own else flat[bounds[i] : bounds[i + 1]]
        else:
            out[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
        return out, closed


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def encode_column(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return encoder(path).encode(column, end_id)
