"""Secret scans with a recursive decoding worklist.

Each text is a layer. Three patterns scan a layer; encoded regions in it (URL
escapes, Unicode and character-reference escapes, base64 on one line or wrapped over
lines, and zlib or gzip streams (also several behind each other), raw deflate, bzip2 or xz data inside either) open as new
layers, which are scanned and opened in turn until nothing new appears. A layer whose content was met before at the same place
of the document is not opened again, so cycles end, while equal regions in other
places get their own spans. Every character of a layer carries the place
of the source characters it came from, escape by escape, so what is found deep inside maps to
a span of the stored text. A match is told in the layer that turned one of its characters. Compressed data has no
such places: each match in it is a span of its own over the whole encoded region.

Defined results: a null text is empty and has no spans; repeated rows give
repeated results; an empty table gives no rows; extra columns are ignored. A
decompressed layer is read to its end, in pieces of about `PIECE_BYTES` that end
where no pattern and no encoded region can cross, and a layer of escapes holds the run
between two such places, so memory is bounded by a piece and the longest run without
such a place. `layers_cut` counts the layers whose stream is damaged or ends early.

No layer is dropped for its content: the shortest match has 12 characters of printable
ASCII, so decoded bytes without such a run can hold neither a match nor an escape, and
base64 of fewer than 16 characters cannot hold a match. Bytes that are no UTF-8 are read as
ASCII with the others replaced, pairs of a character and a zero byte as UTF-16. A base64 run is read from each of its
first four characters (a path, a name or another value may stand before the one it holds).
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, short_batches, slices

#: The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

PIECE_BYTES = 4 << 20
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What wraps a base64 value over lines: a line end, or one written as an escape.
FOLD = re.compile(r"\r?\n[ \t]*|(?:\\r)?\\n")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+|(?:\\r)?\\n))+[A-Za-z0-9+/_-]+={0,2}")
#: What decoded bytes must hold to hold a match or an escape.
RUN = re.compile(rb"[\x20-\x7e]{12}")
#: Bytes that are text throughout, so that nothing else is hidden in them.
WHOLE = re.compile(rb"[\x20-\x7e\t\r\n]+")
WIDE = re.compile(rb"(?P<le>(?:[\x20-\x7e]\x00){12})|(?P<be>(?:\x00[\x20-\x7e]){12})")
#: Bytes read as ASCII, one character each.
ASCII_TABLE = {b: "�" for b in range(127, 256)}
#: A character that stands in no match and no encoded region, before and after decoding.
BREAK = re.compile(r"""[^A-Za-z0-9+/_.=:"'\x20%\\&#;{}-]""")
SPAN = "array<struct<kind:string,start:long,end:long,base:boolean,depth:int,secret:string>>"
SCHEMA = f"doc_id long, spans {SPAN}, layers int, layers_cut int"


def base_matches(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Leftmost non-overlapping matches of each kind, without those that are too short."""
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield "assign", m.start(), m.end(), m[2]
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield "access", m.start(), m.end(), m[0]
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end(), m[0]


def _stream(raw: bytes, bits: int):  # noqa: ANN202
    """A decompressor of what raw begins with, and its name; zlib's window bits serve where no other head is seen."""
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor(), "bz2"
    if raw[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ), "xz"
    return zlib.decompressobj(bits), "deflate"


def headed(raw: bytes) -> bool:
    """Does it begin like a gzip, zlib, bzip2 or xz stream?"""
    return raw[:2] == b"\x1f\x8b" or raw[:3] == b"BZh" or raw[:6] == b"\xfd7zXZ\0" or (len(raw) > 1 and raw[0] == 0x78 and (raw[0] << 8 | raw[1]) % 31 == 0)


def inflated(raw: bytes, bits: int, unused: list[int] | None = None) -> Iterator[tuple[bytes, bool]]:
    """(bytes, damaged) of compressed data, piece by piece; all streams that stand behind each other. What follows them is counted in unused."""
    while raw:
        d, name = _stream(raw, bits)
        tail = raw
        while True:
            try:
                out = d.decompress(tail, PIECE_BYTES)
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                yield b"", True
                return
            tail = d.unconsumed_tail if name == "deflate" else b""
            if out:
                yield out, False
            if d.eof:
                break
            if not out and not tail:  # ends early
                yield b"", True
                return
        raw = d.unused_data if headed(d.unused_data) else b""
        if not raw and unused is not None:
            unused.append(len(d.unused_data))


def inflate(raw: bytes) -> tuple[str, Iterator[tuple[str, bool, bool]], list[int]] | None:
    """The method, the pieces (see pieces) and, when these are read, the bytes behind, of compressed data with a head or whole raw deflate data; None for anything else."""
    if len(raw) < 8:
        return None
    if headed(raw):
        first = next(inflated(raw, 47), (b"", True))
        unused: list[int] = []
        return (_stream(raw, 47)[1], pieces(inflated(raw, 47, unused)), unused) if first[0] else None
    size, held = 0, b""
    for out, damaged in inflated(raw, -15):
        if damaged:
            return None
        size += len(out)
        held = held or (out if RUN.search(out) else b"")
    return ("deflate", pieces(inflated(raw, -15)), [0]) if size and held else None


def pieces(stream: Iterator[tuple[bytes, bool]]) -> Iterator[tuple[str, bool, bool]]:
    """(text, last, damaged) to the end of a stream, cut where no match can cross."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    held: list[str] = []
    broken = False
    for out, damaged in stream:
        broken |= damaged
        text = decoder.decode(out)
        held.append(text)
        if m := BREAK.search(text[::-1]):
            cut = len(text) - m.start()
            held[-1] = text[:cut]
            rest = text[cut:]
            if sum(map(len, held)) >= PIECE_BYTES // 8:
                yield "".join(held), False, False
                held = [rest]
            else:
                held.append(rest)
    yield "".join([*held, decoder.decode(b"", True)]), True, broken


def readable(raw: bytes) -> tuple[str, int, int] | None:
    """Decoded bytes that may hold a match, the bytes of each character (0: as many as in UTF-8) and how many bytes stand before them; else None."""
    if RUN.search(raw):
        try:
            return raw.decode(), int(raw.isascii()), 0
        except UnicodeDecodeError:
            return raw.decode("latin-1").translate(ASCII_TABLE), 1, 0
    if m := WIDE.search(raw):
        skip = m.start() % 2
        units = raw[skip : len(raw) - (len(raw) - skip) % 2]
        # Two bytes a character: what is no ASCII is replaced, as in other bytes that are no UTF-8.
        high, low = (units[1::2], units[::2]) if m["le"] else (units[::2], units[1::2])
        return "".join(chr(b) if not a and b < 127 else "\ufffd" for a, b in zip(high, low, strict=True)), 2, skip
    return None


class Layer:
    """A text and, for each of its characters, the source characters [start, end) behind it; fresh marks those decoded in this layer, packed that all have one place."""

    __slots__ = ("text", "start", "end", "fresh", "path", "packed")

    def __init__(self, text: str, start: array, end: array, fresh: bytearray, packed: bool = False) -> None:
        self.text, self.start, self.end, self.fresh, self.path, self.packed = text, start, end, fresh, (), packed

    def key(self) -> bytes:
        """Content and place."""
        h = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for part in (self.start, self.end):
            h.update(part)
        return h.digest()


def _runs(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int, list[re.Match]]]:
    """The runs between two places that no match can cross which hold escapes: bounds and escapes."""
    lo, hi, met = 0, -1, []
    for m in pattern.finditer(text):
        if m.start() >= hi:
            if met:
                yield lo, hi, met
            size, gap = 4096, None  # look back in growing steps
            while not (gap := BREAK.search(text[max(0, m.start() - size) : m.start()][::-1])) and size < m.start():
                size *= 4
            lo = m.start() - gap.start() if gap else 0
            behind = BREAK.search(text, m.end())
            hi, met = behind.start() if behind else len(text), []
        met.append(m)
    if met:
        yield lo, hi, met


def _escapes(text: str, get, name: str, pattern: re.Pattern, turn) -> Iterator[tuple[str, Layer]]:  # noqa: ANN001
    """Runs that hold escapes, as layers with each escape turned into its own characters."""
    for lo, hi, met in _runs(text, pattern):
        out: list[str] = []
        start, end, fresh = array("q"), array("q"), bytearray()

        def copy(a: int, z: int) -> None:
            out.append(text[a:z])
            fresh.extend(bytes(z - a))
            for i in range(a, z):
                s, e = get(i)
                start.append(s)
                end.append(e)

        last = lo
        for m in met:
            copy(last, m.start())
            for chars, a, z in turn(m[0]):
                out.append(chars)
                start.extend([get(m.start() + a)[0]] * len(chars))
                end.extend([get(m.start() + z - 1)[1]] * len(chars))
                fresh.extend(b"\1" * len(chars))
            last = m.end()
        copy(last, hi)
        yield name, Layer("".join(out), start, end, fresh)


def _one(code: int) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _unescape(run: str) -> Iterator[tuple[str, int, int]]:
    """(characters, from, to) of each escape of a run; two escapes of a surrogate pair are one character."""
    if run.startswith("&"):
        yield html.unescape(run), 0, len(run)
    elif run.startswith("\\u{"):
        yield _one(int(run[3:-1], 16)), 0, len(run)
    elif run.startswith("\\u"):
        at = 0
        while at < len(run):
            code, size = int(run[at + 2 : at + 6], 16), 6
            if 0xD800 <= code < 0xDC00 and at + 12 <= len(run) and 0xDC00 <= (low := int(run[at + 8 : at + 12], 16)) < 0xE000:
                code, size = 0x10000 + (code - 0xD800 << 10) + low - 0xDC00, 12
            yield _one(code), at, at + size
            at += size
    else:
        yield _one(int(run[2:], 16)), 0, len(run)


def _unpercent(run: str) -> Iterator[tuple[str, int, int]]:
    """(character, from, to): the escapes of one UTF-8 character together, any other byte replaced."""
    decoder, begun = codecs.getincrementaldecoder("utf-8")("replace"), 0
    for at, byte in enumerate(bytes.fromhex(run.replace("%", ""))):
        got = decoder.decode(bytes([byte]))
        if len(got) > 1:  # a broken group before this byte
            yield got[:-1], begun * 3, at * 3
            begun, got = at, got[-1]
        elif got == "\ufffd" and byte >= 0xC0 and begun < at:  # the group before broke off, this byte begins another
            yield got, begun * 3, at * 3
            begun, got = at, ""
        if got:
            yield got, begun * 3, at * 3 + 3
            begun = at + 1
    if rest := decoder.decode(b"", True):
        yield rest, begun * 3, len(run)


def opened(layer: Layer | str) -> Iterator[tuple[str, Layer, bool, bool]]:
    """The layers directly inside a layer: (name, layer or a piece of it, last piece, damaged)."""
    if isinstance(layer, str):
        text, packed = layer, False

        def get(i: int) -> tuple[int, int]:
            return i, i + 1
    else:
        text, packed = layer.text, layer.packed

        def get(i: int) -> tuple[int, int]:
            return layer.start[i], layer.end[i]

    def inside(name: str, got: tuple[str, Iterator[tuple[str, bool, bool]], list[int]], lo: int, hi: int) -> Iterator[tuple[str, Layer, bool, bool]]:
        s, e = get(lo)[0], get(hi - 1)[1]
        for text, last, damaged in got[1]:
            n = len(text)
            yield f"{name}>{got[0]}", Layer(text, array("q", [s]) * n, array("q", [e]) * n, bytearray(b"\1") * n, True), last, damaged

    def plain(name: str, new: Layer) -> tuple[str, Layer, bool, bool]:
        new.packed = packed
        return name, new, True, False

    if "%" in text:
        for name, new in _escapes(text, get, "url", URL, _unpercent):
            yield plain(name, new)
        for m in URL.finditer(text):  # escaped bytes may be compressed data
            if len(m[0]) >= 24 and (got := inflate(bytes.fromhex(m[0].replace("%", "")))):
                yield from inside("url", got, m.start(), m.end())
    if "\\" in text or "&#" in text:
        for name, new in _escapes(text, get, "unicode", ESCAPE, _unescape):
            yield plain(name, new)
    for m in BASE64.finditer(text):
        yield from _base64(m[0], range(m.start(), m.end()), get, inside, plain)
    if "\n" in text or "\\n" in text:
        for m in WRAPPED.finditer(text):
            if m.end() - m.start() < 16:
                continue
            for block in _blocks(text, m.start(), m.end()):
                places = [i for a, z in block for i in range(a, z)]
                yield from _base64("".join(text[a:z] for a, z in block), places, get, inside, plain)


def _blocks(text: str, lo: int, hi: int) -> Iterator[list[tuple[int, int]]]:
    """The bounds of the lines of each wrapped value between lo and hi: lines of 16 characters or more, or of one length, and a last one that may be shorter."""
    block: list[tuple[int, int]] = []
    bounds = [(f.start(), f.end()) for f in FOLD.finditer(text, lo, hi)] + [(hi, hi)]
    for stop, after in bounds:
        size = stop - lo
        if block:
            first, last = (z - a for a, z in (block[0], block[-1]))
            if not (last >= 16 or (last == first and size <= first)):
                if len(block) > 1:
                    yield block
                block = []
        block.append((lo, stop))
        lo = after
    if len(block) > 1:
        yield block


def _base64(run: str, places, get, inside, plain) -> Iterator[tuple[str, Layer, bool, bool]]:  # noqa: ANN001
    """The layers inside a run of base64 characters that stand at places, read from each of the first four."""
    run = run.rstrip("=").translate({45: 43, 95: 47})
    for skip in range(4):
        core = run[skip:]
        core = core[:-1] if len(core) % 4 == 1 else core
        if len(core) < 11:
            return
        raw = binascii.a2b_base64(core + "=" * (-len(core) % 4))
        got = inflate(raw)
        if got:
            yield from inside("base64", got, places[skip], places[-1] + 1)
            if got[2] and not got[2][0]:  # read to its end: nothing stands behind
                return
            continue
        inner = readable(raw)
        if inner is None:
            continue
        start, end, byte, last = array("q"), array("q"), inner[2], len(places) - 1
        for c in inner[0]:
            n = inner[1] or len(c.encode())
            start.append(get(places[skip + byte * 4 // 3])[0])
            end.append(get(places[min(last, skip + (byte + n) * 4 // 3 + ((byte + n) * 4 % 3 > 0) - 1)])[1])
            byte += n
        yield plain("base64", Layer(inner[0], start, end, bytearray(b"\1") * len(inner[0])))
        if WHOLE.fullmatch(raw):
            return


def scan(text: str) -> tuple[list[dict], int, int]:
    """All spans of a text, the layers opened and how many of them were damaged."""
    spans = [{"kind": k, "start": s, "end": e, "base": True, "depth": 0, "secret": v} for k, s, e, v in base_matches(text)]
    have = {(x["kind"], x["start"], x["end"], None) for x in spans}
    seen, layers, cut_layers = set(), 0, 0

    def spread(layer: Layer | str, path: tuple[str, ...]) -> None:
        nonlocal layers, cut_layers
        work = [(layer, path)]
        while work:
            layer, path = work.pop()
            for name, new, last, damaged in opened(layer):
                key = new.key()
                if key in seen:
                    continue
                seen.add(key)
                layers += last
                cut_layers += damaged
                new.path = (*path, name)
                for kind, s, e, value in base_matches(new.text):
                    if not any(new.fresh[s:e]):
                        continue  # met already, one layer up
                    # What is inside compressed data is told apart by its place there.
                    span = (f"{'>'.join(new.path)}>{kind}", min(new.start[s:e]), max(new.end[s:e]), (key, s) if new.packed else None)
                    if span not in have:
                        have.add(span)
                        spans.append({"kind": span[0], "start": span[1], "end": span[2], "base": False, "depth": len(new.path), "secret": value})
                if last:
                    work.append((new, new.path))
                else:
                    spread(new, new.path)  # at once, so that only one piece of a stream is held

    spread(text, ())
    rank = {k: i for i, k in enumerate(KINDS)}
    spans.sort(key=lambda x: (x["start"], rank.get(x["kind"], len(KINDS)), x["kind"], x["end"], x["secret"]))
    return spans, layers, cut_layers


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end, base, depth, secret), layers, layers_cut of every document."""
    short_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("depth", pa.int32()), ("secret", pa.string())]))
        for b in slices(batches):
            got = [scan(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=["doc_id", "spans", "layers", "layers_cut"])

    return pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _joined(spans):  # noqa: ANN001, ANN202
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: counts and digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined("spans").alias("spans"), "layers", "layers_cut")
