"""Secrets in whole texts, also inside nested encodings.

Every text is scanned as it is (the base spans).  Then a worklist unwraps layers:
percent-encoding, Unicode and hex escapes, base64 (also of UTF-16), and compressed data
(gzip, zlib, bzip2, xz, nested and of many members) in base64, percent-encoded or
hex-escaped bytes.  Percent-encoded bytes that are not UTF-8 stand for Latin-1 characters.
The whole text with all its percent runs, or all its escapes, replaced becomes a layer, so
that a decoded value keeps a plain key before it; base64 that decodes to readable text
becomes a layer of its own, as does base64 over several lines, whether the breaks are
plain or written as escapes, and each readable stretch under any of the four alignments.  A layer is scanned by the same patterns and searched for
further layers, until nothing new appears; a layer whose content was
seen before over the same place is not opened again, so cycles end.  A find in a layer
maps back to the code points of the text that the layer's characters came from: escapes
character by character, base64 and compressed data to the whole of their region that holds
the readable stretch or the outermost compressed stream.

Null and empty texts have no finds.  Rows are independent, so repeated rows give repeated
results and an empty table none.  Further columns are ignored.  Decompressed text beyond
``LAYER_BYTES`` is cut only where no find and no encoded part can lie across, so the cuts
change no result; content without such a place, or that is not text, is held whole.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from famloom.llm.common import id_and_text, slices

#: Decompressed text is cut from this size on, at a place within so many bytes of its end.
LAYER_BYTES = 4 << 20
WINDOW_OVERLAP = 64 << 10

#: Kinds in their order, patterns, and how much must match.
KINDS = ("assign", "access", "hex")
_PATTERNS = {
    "assign": re.compile(
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        re.IGNORECASE | re.ASCII,
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),  # the first 24 of a run start the whole run
}
#: What a text must hold for a pattern to match, for a quick look at many texts.
_HINTS = {
    "assign": r"(?i)passw|secret|token|api_?key",
    "access": r"AKIA[A-Z0-9]",
    "hex": r"[0-9a-f]{24}",
}
#: What a text must hold to be unwrapped: the least that each pattern of encoded parts matches.
_WRAPPED = r"%u?[0-9A-Fa-f]{2}|\\(?:u\{?|U|x)[0-9A-Fa-f]|[A-Za-z0-9+/_-]{16}"

_PERCENT_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|(?:%u[0-9A-Fa-f]{4})+|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})"
    r"|(?:\\x[0-9A-Fa-f]{2})+"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A line break with the next line's indent, plain or as escapes.
_BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*")
#: The same over lines, of which all but the last are as long; a single line matches too.
_BASE64_LINES = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:BREAK[A-Za-z0-9+/_-]{16,}+)*+"
    r"(?:BREAK[A-Za-z0-9+/_-]++)?={0,2}".replace("BREAK", _BREAK.pattern)
)

#: How compressed data begin, as bytes and as text with encoded bytes.
_STREAM = re.compile(rb"(\x1f\x8b\x08)|(\x78[\x01\x5e\x9c\xda])|(BZh[1-9]1AY&SY)|(\xfd7zXZ\0)")
_OPENERS: list[Callable] = [lambda: zlib.decompressobj(31), zlib.decompressobj, bz2.BZ2Decompressor, lzma.LZMADecompressor]
_STREAM_TEXT = {
    kind: re.compile(
        "E1[fF]E8[bB]|(?:x|E78)(?:E01|E5[eE]|\\^|E9[cC]|E[dD][aA])|(?:B|E42)(?:Z|E5[aA])(?:h|E68)|E[fF][dD](?:7|E37)".replace("E", e)
    )
    for kind, e in (("%", "%"), ("\\x", r"\\x"))
}
_BYTE_RUN = {"%": re.compile("[!-~]*"), "\\x": re.compile("[ -~]*")}
_BYTE = {
    "%": re.compile("%([0-9A-Fa-f]{2})|(?s:.)"),
    "\\x": re.compile(r"\\x([0-9A-Fa-f]{2})|\\[abfnrtv0\\'\"]|(?s:.)"),
}
_NAMED = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0"))
#: Text of the length of the shortest find among other bytes.
_STRETCH = re.compile(
    rb"(?:[\t\n\f\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
    rb"|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}"
)
#: The same in UTF-16 of either byte order; what the patterns match is ASCII.
_WIDE = ((re.compile(rb"(?:[\t\n\f\r\x20-\x7e]\0){12,}"), 0), (re.compile(rb"(?:\0[\t\n\f\r\x20-\x7e]){12,}"), 1))
_ODD = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f]+")
#: Where decompressed text may be cut: no pattern above goes on from there.
_CUT = re.compile(rb"\n(?=[^A-Za-z0-9+/_\x20\t-])|(?=[\xc2-\xf4])")

_OUT = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
    "base_sha256 string, spans string, n_decoded bigint"
)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain finds in a text."""
    found = []
    for number, kind in enumerate(KINDS):
        for match in _PATTERNS[kind].finditer(text):
            if kind == "assign" and len(match[2]) < 6 or kind == "access" and len(match[0]) < 20:
                continue
            found.append((match.start(), number, match.end()))
    return sorted(found)


class _Same:
    """One number for every character of a layer."""

    def __init__(self, number: int):
        self.number = number

    def __getitem__(self, at: int | slice) -> int | array:
        return array("i", [self.number]) * (at.stop - at.start) if isinstance(at, slice) else self.number


class _Layer:
    """Decoded text; character i came from the code points begin[i]..end[i] of the original."""

    def __init__(self, text: str, begin: Sequence[int], end: Sequence[int], fresh: Sequence[int]):
        self.text, self.begin, self.end, self.fresh = text, begin, end, fresh

    def key(self) -> tuple:
        digest = hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest()
        return digest, self.begin[0], self.end[-1]


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(map(len, _ODD.findall(text)))
    return text if text and odd * 10 <= len(text) else None


def _utf16(units: str) -> str:
    data = b"".join(int(u, 16).to_bytes(2, "big") for u in units.split(units[:2])[1:])
    return data.decode("utf-16-be", "surrogatepass")


def _substituted(layer, pattern, decoded) -> _Layer | None:
    """The whole layer with every match of ``pattern`` replaced; the other characters stay.

    ``decoded`` gives the new characters and how many old ones each came from.
    """
    text, begin, end, fresh, at = [], array("i"), array("i"), bytearray(), 0

    def keep(stop: int) -> None:
        text.append(layer.text[at:stop])
        begin.extend(layer.begin[at:stop])
        end.extend(layer.end[at:stop])
        fresh.extend(bytes(stop - at))

    for match in pattern.finditer(layer.text):
        new = decoded(match)
        if new is None:
            continue
        keep(match.start())
        at = match.start()
        for char, width in zip(*new):
            text.append(char)
            begin.append(layer.begin[at])
            at += width
            end.append(layer.end[at - 1])
        fresh.extend(b"\1" * len(new[0]))
    if not any(fresh):
        return None
    keep(len(layer.text))
    return _Layer("".join(text), begin, end, fresh)


def _percent(match: re.Match) -> tuple[str, list[int]] | None:
    text = bytes.fromhex(match[0].replace("%", "")).decode("utf-8", "surrogateescape")
    widths = [3 if "\udc80" <= c <= "\udcff" else 3 * len(c.encode()) for c in text]
    return "".join(chr(ord(c) - 0xDC00) if "\udc80" <= c <= "\udcff" else c for c in text), widths


def _escape(match: re.Match) -> tuple[str, list[int]] | None:
    if match[1] or match[2]:
        point = int(match[1] or match[2], 16)
        return (chr(point), [len(match[0])]) if point < 0x110000 else None
    if match[0].startswith("\\x"):
        text = bytes.fromhex(match[0].replace("\\x", "")).decode("latin-1")
        return text, [4] * len(text)
    text = _utf16(match[0])
    return text, [12 if c > "\uffff" else 6 for c in text]


def _decompressed(data: memoryview, kind: int) -> Iterator[tuple[bytes, int]]:
    """(new bytes, end of the last whole member so far) of a stream and the members after it."""
    machine, at, whole = _OPENERS[kind](), 0, 0
    while at < len(data):
        rest = bytes(data[at : at + WINDOW_OVERLAP])
        at += len(rest)
        more = True
        try:
            while more and not machine.eof:
                new = machine.decompress(rest, LAYER_BYTES)
                rest = getattr(machine, "unconsumed_tail", b"")
                more = bool(rest) or len(new) == LAYER_BYTES or not getattr(machine, "needs_input", True)
                if machine.eof:
                    at -= len(machine.unused_data)
                    whole = at
                yield new, whole
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
            return
        if machine.eof:
            head = _STREAM.match(bytes(data[at : at + 16]))
            if not head or head.lastindex != kind + 1:
                return
            machine = _OPENERS[kind]()


def _windows(parts: Iterator[tuple[bytes, int]]) -> Iterator[bytes]:
    """The content of a stream, cut only where that changes nothing."""
    held, goal = bytearray(), LAYER_BYTES
    for new, _ in parts:
        held += new
        if len(held) >= goal:
            near = max(0, len(held) - WINDOW_OVERLAP)
            cut = max((near + m.end() for m in _CUT.finditer(held[near:])), default=0)
            if cut and _readable(bytes(held[:cut])):
                yield bytes(held[:cut])
                del held[:cut]
            goal = max(LAYER_BYTES, 2 * len(held))
    if held:
        yield bytes(held)


def _contents(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, first byte, end) of readable parts of bytes, also inside nested compressed streams."""
    seen: set[tuple] = set()
    work: list[Iterator] = [iter([(data, None)])]

    def unpacked(part: bytes, streams: list, place) -> Iterator[tuple]:
        for first, end, kind in streams:
            for window in _windows(_decompressed(memoryview(part)[first:], kind)):
                yield window, place or (first, end)

    while work:
        part, place = next(work[-1], (None, None))
        if part is None:
            work.pop()
            continue
        key = hashlib.sha256(part).digest(), place
        if key in seen:
            continue
        seen.add(key)
        if b"\0" in part:
            for pattern, first in _WIDE:
                for match in pattern.finditer(part):
                    yield match[0][first::2].decode("ascii"), *(place or match.span())
        text = _readable(part)
        if text is not None:
            yield text, *(place or (0, len(part)))
            continue
        streams, gaps, at = [], [], 0
        for head in _STREAM.finditer(part):
            first = head.start()
            if first < at:
                continue
            made = whole = 0
            for new, whole in _decompressed(memoryview(part)[first:], head.lastindex - 1):
                made += len(new)
            if made:
                streams.append((first, first + whole if whole else len(part), head.lastindex - 1))
            if whole:
                gaps.append((at, first))
                at = first + whole
        work.append(unpacked(part, streams, place))
        for first, end in [*gaps, (at, len(part))]:
            for match in _STRETCH.finditer(part, first, end):
                yield match[0].decode(), *(place or match.span())


def _solid(layer: _Layer, text: str, first: int, end: int) -> _Layer:
    return _Layer(text, _Same(layer.begin[first]), _Same(layer.end[end - 1]), _Same(1))


def _base64_layers(layer: _Layer, region: re.Match) -> Iterator[_Layer]:
    raw, places = region[0].rstrip("="), None
    breaks = [match.span() for match in _BREAK.finditer(raw)]
    if breaks:
        ends, begins = [b[0] for b in breaks] + [len(raw)], [0] + [b[1] for b in breaks]
        places = array("i", (i for first, end in zip(begins, ends) for i in range(first, end)))
        raw = _BREAK.sub("", raw)
    size, start = len(raw), region.start()
    raw = raw.replace("-", "+").replace("_", "/")
    for shift in range(4):
        part = raw[shift : size - ((size - shift) % 4 == 1)]
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        for text, first, end in _contents(data):
            begin, last = shift + 4 * first // 3, shift - (-4 * end // 3) - 1
            if places:
                begin, last = places[begin], places[last]
            stop = region.end() if end == len(data) else start + last + 1
            yield _solid(layer, text, start + begin, stop)


def _byte_layers(layer: _Layer, kind: str) -> Iterator[_Layer]:
    """Compressed data in percent-encoded or hex-escaped bytes, between which others stand as they are."""
    done = 0
    for head in _STREAM_TEXT[kind].finditer(layer.text):
        run = _BYTE_RUN[kind].match(layer.text, head.start())
        if head.start() < done or kind not in run[0]:
            continue
        data, places = bytearray(), []
        for match in _BYTE[kind].finditer(run[0]):
            part = match[0]
            places.append(run.start() + match.start())
            if match[1]:
                data.append(int(match[1], 16))
            else:
                data.append(_NAMED.get(part[1], ord(part[1])) if len(part) == 2 else ord(part))
        places.append(run.end())
        if _STREAM.match(data):
            for text, first, end in _contents(bytes(data)):
                if first == 0:
                    done = max(done, places[end])
                    yield _solid(layer, text, places[0], places[end])


def unwrap(text: str) -> set[tuple[int, int, int]]:
    """(start, kind number, end) of finds inside encoded parts, in the text's code points."""
    found: set[tuple[int, int, int]] = set()
    seen: set[tuple] = set()

    def opened(layer: _Layer) -> Iterator[_Layer]:
        yield _substituted(layer, _PERCENT_RUN, _percent)
        yield _substituted(layer, _ESCAPE, _escape)
        for kind in ("%", "\\x"):
            if kind in layer.text:
                yield from _byte_layers(layer, kind)
        for region in _BASE64.finditer(layer.text):
            yield from _base64_layers(layer, region)
        for region in _BASE64_LINES.finditer(layer.text):
            if _BREAK.search(region[0]):
                yield from _base64_layers(layer, region)

    whole = range(len(text))
    work = [_Layer(text, whole, range(1, len(text) + 1), None)]
    while work:
        for layer in opened(work.pop()):
            if layer is None or layer.key() in seen:
                continue
            seen.add(layer.key())
            for start, kind, end in scan(layer.text):
                if any(layer.fresh[start:end]):
                    found.add((min(layer.begin[start:end]), kind, max(layer.end[start:end])))
            work.append(layer)
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in slices(batches):
        texts = batch.column("text")
        has = lambda p: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False)
        plain = has(_HINTS["assign"]) | has(_HINTS["access"]) | has(_HINTS["hex"])
        wrapped = has(_WRAPPED)
        n = len(texts)
        counts, digests, spans, decoded = [[0] * n for _ in KINDS], [empty] * n, [""] * n, [0] * n
        for i in (plain | wrapped).nonzero()[0].tolist():
            text = texts[i].as_py()
            base = scan(text) if plain[i] else []
            extra = unwrap(text) - set(base) if wrapped[i] else set()
            for number in range(len(KINDS)):
                counts[number][i] = sum(kind == number for _, kind, _ in base)
            digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
            spans[i] = _joined(sorted({*base, *extra}))
            decoded[i] = len(extra)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array(digests),
                pa.array(spans),
                pa.array(decoded, pa.int64()),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: counts of base finds per kind, digest of base spans, all spans, decoded finds."""
    return id_and_text(docs).mapInArrow(_run, _OUT)
