"""Secrets behind nested encodings: a worklist of layers, unwrapped until nothing new appears.

A layer is a text together with the place in the document that every one of its characters stands
for.  The document is the first layer; each layer is searched with the same patterns and then
unwrapped: URL escapes and Unicode escapes (in place, so that what is around them stays as context),
base64 runs, and compressed data found behind either.  New layers join the worklist unless the
same content was already seen at the same place, which also ends cycles (an archive that unpacks
to itself).  A find in a layer is mapped back to the characters of the document it comes from:
escape by escape, base64 group by base64 group; what was compressed stands for the whole run.

Three base kinds are defined by their patterns on the document itself and always stay; finds of the
layers are added.  All unwrapping but unpacking makes a text shorter or takes the escapes
out of it, so the worklist ends; unpacking is bounded by ``MOST`` bytes for each layer and
``ALTOGETHER`` per document, and a run that would unpack to more is itself reported, as the kind
``oversize``, never skipped in silence.

Defined results: a null text is empty and holds nothing; places are code points, ends exclusive;
repeated rows are treated alike; an empty table gives an empty table; other columns are passed on
(one named as the result is replaced).  Texts are read whole, and documents never leave their task.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.text import small_batches, whole

# The base kinds, their patterns and least lengths (of a group, 0 the whole match).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {
    "assign": (re.compile(ASSIGN, re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    # a run is maximal anyway, so its least length can be part of the pattern
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
OVERSIZE = "oversize"
KINDS = (*BASE, OVERSIZE)
MOST = 64 << 20
ALTOGETHER = 256 << 20
SHORTEST = 16

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"(?P<bytes>(?:\\x[0-9A-Fa-f]{2})+)|\\u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|\\U(?P<wide>[0-9A-Fa-f]{8})"
    r"|[\\%]u(?P<high>[Dd][89ABab][0-9A-Fa-f]{2})[\\%]u(?P<low>[Dd][C-Fc-f][0-9A-Fa-f]{2})|[\\%]u(?P<four>[0-9A-Fa-f]{4})"
    r"|&#[xX](?P<hex>[0-9A-Fa-f]{1,6});|&#(?P<dec>[0-9]{1,7});|(?P<full>[\uff01-\uff5e]+)"
)
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{4,})*={0,2}")
_BREAK = re.compile(r"[\r\n=]+")
_NOT_TEXT = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\ufffe\uffff]")


class Layer:
    """A text, the place of every character in the document (None: the document itself) and how it was reached."""

    __slots__ = ("text", "starts", "ends", "path")

    def __init__(self, text: str, starts=None, ends=None, path: tuple = ()):
        self.text, self.starts, self.ends, self.path = text, starts, ends, path

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])

    def key(self):
        where = self.place(0, len(self.text)) if self.text else (0, 0)
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), where


class Budget:
    """Bytes that a document may still unpack to."""

    def __init__(self, most: int = MOST, altogether: int = ALTOGETHER):
        self.most, self.left = most, altogether

    def limit(self) -> int:
        return min(self.most, self.left)


def matches(text: str):
    """(kind, start, end) of the base patterns, leftmost and non-overlapping per kind; failing matches are dropped, not retried."""
    for kind, (pattern, group, least) in BASE.items():
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


# ---- unwrapping ----------------------------------------------------------------------------------

def _unpackers(data: bytes):
    """(name, new decompressor, unread input of a finished one) for what the first bytes look like."""
    import bz2
    import lzma

    if data[:3] == b"\x1f\x8b\x08":
        return "gzip", lambda: zlib.decompressobj(31)
    if len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0 and not data[1] & 0x20:
        return "zlib", zlib.decompressobj
    if data[:3] == b"BZh" and data[4:10] == b"1AY&SY":
        return "bzip2", bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return "xz", lzma.LZMADecompressor
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", None
    return None


def unpack(data: bytes, limit: int):
    """(name, bytes) of compressed data, (name, None) if it is longer than ``limit``; None if it isn't compressed."""
    found = _unpackers(data)
    if found is None:
        return None
    name, make = found
    try:
        if name == "zstd":
            import zstandard

            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data, read_across_frames=True) as reader:
                out = reader.read(limit + 1)
        else:
            out, rest = b"", data
            while rest and len(out) <= limit:
                one = make()
                # members may follow each other; what is no member any more is left alone
                try:
                    out += one.decompress(rest, limit + 1 - len(out))
                except Exception:
                    if not out:
                        raise
                    break
                if not one.eof:
                    break
                rest = one.unused_data
                if not rest or _unpackers(rest) is None:
                    break
    except Exception:  # damaged data is no layer
        return None
    return (name, None) if len(out) > limit else (name, out) if out else None


def as_text(data: bytes):
    """(text, byte offsets of its characters and the end) if the bytes are readable text, else None."""
    import numpy as np

    wide = len(data) >= 8 and len(data) % 2 == 0 and data[1::2].count(0) >= 0.9 * (len(data) // 2)
    try:
        text = data.decode("utf-16-le" if wide else "utf-8")
    except UnicodeDecodeError:
        return None
    if not text or _NOT_TEXT.search(text):
        return None
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if wide:
        widths = 2 + 2 * (points > 0xFFFF)
    else:
        widths = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
    return text, np.concatenate(([0], np.cumsum(widths)))


def _from_bytes(data: bytes, starts, ends, path: tuple, budget: Budget, finds: set):
    """Layers of bytes whose i-th one stands for ``starts[i]`` to ``ends[i]`` of the document."""
    while True:
        got = unpack(data, budget.limit())
        if got is None:
            break
        name, more = got
        if more is None:
            finds.add((int(starts[0]), OVERSIZE, int(ends[-1]), ">".join((*path, name))))
            return
        budget.left -= len(more)
        import numpy as np

        starts, ends = np.broadcast_to(starts[:1], len(more)), np.broadcast_to(ends[-1:], len(more))
        path = (*path, name)
        if more == data:
            return
        data = more
    read = as_text(data)
    if read is not None:
        text, at = read
        yield Layer(text, starts[at[:-1]], ends[at[1:] - 1], path)


def _code_points(data: bytes):
    """(bytes used, character or None) along escaped bytes; None where they are no UTF-8."""
    k = 0
    while k < len(data):
        n = 1 if data[k] < 0x80 else 2 if 0xC2 <= data[k] < 0xE0 else 3 if 0xE0 <= data[k] < 0xF0 else 4 if 0xF0 <= data[k] < 0xF5 else 0
        try:
            char = data[k:k + n].decode("utf-8") if n else None
        except UnicodeDecodeError:
            char = None
        yield (n if char else 1), char
        k += n if char else 1


class _Rewriter:
    """Collects a layer's text with some stretches replaced, and the places of the result."""

    def __init__(self, layer: Layer):
        self.layer, self.pieces, self.starts, self.ends, self.done = layer, [], [], [], 0

    def _copy(self, upto: int) -> None:
        import numpy as np

        if upto > self.done:
            self.pieces.append(self.layer.text[self.done:upto])
            own = self.layer.starts is None
            self.starts.append(np.arange(self.done, upto) if own else self.layer.starts[self.done:upto])
            self.ends.append(np.arange(self.done + 1, upto + 1) if own else self.layer.ends[self.done:upto])
        self.done = upto

    def put(self, start: int, end: int, char: str) -> None:
        self._copy(start)
        a, b = self.layer.place(start, end)
        self.pieces.append(char)
        self.starts.append([a] * len(char))
        self.ends.append([b] * len(char))
        self.done = end

    def layer_of(self, name: str):
        import numpy as np

        if not self.pieces:
            return None
        self._copy(len(self.layer.text))
        return Layer("".join(self.pieces), np.concatenate(self.starts), np.concatenate(self.ends), (*self.layer.path, name))


def _byte_run(layer: Layer, start: int, width: int, data: bytes, name: str, budget: Budget, finds: set):
    """Layers of a run of escaped bytes that is compressed data."""
    import numpy as np

    if len(data) >= SHORTEST and _unpackers(data) is not None:
        at = start + width * np.arange(len(data))
        starts = at if layer.starts is None else layer.starts[at]
        ends = at + width if layer.ends is None else layer.ends[at + width - 1]
        yield from _from_bytes(data, starts, ends, (*layer.path, name), budget, finds)


def _url(layer: Layer, budget: Budget, finds: set):
    if "%" not in layer.text:
        return
    new = _Rewriter(layer)
    for m in _PERCENT.finditer(layer.text):
        data, at = bytes.fromhex(m.group().replace("%", "")), m.start()
        yield from _byte_run(layer, at, 3, data, "url", budget, finds)
        for n, char in _code_points(data):
            if char is not None:
                new.put(at, at + 3 * n, char)
            at += 3 * n
    whole_layer = new.layer_of("url")
    if whole_layer is not None:
        yield whole_layer


def _unicode(layer: Layer, budget: Budget, finds: set):
    new = _Rewriter(layer)
    for m in _ESCAPE.finditer(layer.text):
        kind, value, at = m.lastgroup, m.group(m.lastgroup), m.start()
        if kind == "full":
            for k, char in enumerate(value):
                new.put(at + k, at + k + 1, chr(ord(char) - 0xFEE0))
        elif kind == "bytes":
            data = bytes.fromhex(value.replace("\\x", ""))
            yield from _byte_run(layer, at, 4, data, "unicode", budget, finds)
            for n, char in _code_points(data):
                new.put(at, at + 4 * n, char if char is not None else chr(data[(at - m.start()) // 4]))
                at += 4 * n
        else:
            if kind == "low":
                point = 0x10000 + (int(m.group("high"), 16) - 0xD800 << 10) + int(value, 16) - 0xDC00
            else:
                point = int(value, 10 if kind == "dec" else 16)
            if 0 < point < 0xD800 or 0xDFFF < point < 0x110000:
                new.put(at, m.end(), chr(point))
    whole_layer = new.layer_of("unicode")
    if whole_layer is not None:
        yield whole_layer


def _decoded(run: str):
    """Bytes of a base64 run (either alphabet, padded or not), None if it can't be one."""
    if any(c in run for c in "+/") and any(c in run for c in "-_"):
        return None
    run = run.replace("-", "+").replace("_", "/")
    run = run[:-1] if len(run) % 4 == 1 else run
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return None


def _base64(layer: Layer, budget: Budget, finds: set):
    import numpy as np

    def tried(start: int, end: int):
        raw = layer.text[start:end]
        breaks = [m.span() for m in _BREAK.finditer(raw)]
        at = np.arange(start, end)
        if breaks:
            use = np.ones(len(raw), bool)
            for a, b in breaks:
                use[a:b] = False
            at, raw = at[use], _BREAK.sub("", raw)
        data = _decoded(raw)
        if not data or len(data) < SHORTEST * 3 // 4:
            return None
        k = 8 * np.arange(len(data))
        first, last = at[k // 6], at[(k + 7) // 6]
        starts = first if layer.starts is None else layer.starts[first]
        ends = last + 1 if layer.ends is None else layer.ends[last]
        before = len(finds)
        got = list(_from_bytes(data, starts, ends, (*layer.path, "base64"), budget, finds))
        return got if got or len(finds) > before else None

    for m in _RUN.finditer(layer.text):
        got = tried(*m.span())
        if got is None:
            # lines that do not belong together, or parts of a path or of a name
            parts = [p for p in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", m.group()) if p.group() != m.group()]
            parts += [p for cut in ("/", "-", "_") if cut in m.group() for p in re.finditer(rf"[^\r\n={cut}]{{16,}}={{0,2}}", m.group())]
            got = [x for p in parts for x in tried(m.start() + p.start(), m.start() + p.end()) or ()]
        yield from got


def secrets(text: str, most: int = MOST, altogether: int = ALTOGETHER) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, path) of all finds, sorted; base finds have an empty path."""
    root, budget = Layer(text), Budget(most, altogether)
    base = {(s, kind, e) for kind, s, e in matches(text)}
    finds: set = set()
    seen, work = {root.key()}, [root]
    while work:
        layer = work.pop()
        for unwrap in (_url, _unicode, _base64):
            for new in unwrap(layer, budget, finds):
                key = new.key()
                if key in seen:
                    continue
                seen.add(key)
                work.append(new)
                for kind, s, e in matches(new.text):
                    a, b = new.place(s, e)
                    if (a, kind, b) not in base:
                        finds.add((a, kind, b, ">".join(new.path)))
    # the same place may be reached in several ways: the shortest path tells
    shortest: dict = {}
    for s, kind, e, path in finds:
        got = shortest.get((s, kind, e))
        if got is None or (path.count(">"), path) < (got.count(">"), got):
            shortest[s, kind, e] = path
    rows = [(s, kind, e, "") for s, kind, e in base] + [(s, kind, e, p) for (s, kind, e), p in shortest.items()]
    return sorted(rows, key=lambda r: (r[0], KINDS.index(r[1]), r[2]))


# ---- documents -----------------------------------------------------------------------------------

FIND = "array<struct<start:int,kind:string,end:int,path:string>>"


def scan(docs: DataFrame, text: str = "text", into: str = "secrets", most: int = MOST, altogether: int = ALTOGETHER) -> DataFrame:
    """All input columns and ``into``: the finds of each text as (start, kind, end, path), sorted by start, kind and end."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != into]
    names = [f"c{k}" for k in range(len(kept))]
    thin = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)])
    column = names[kept.index(text)]
    found = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("path", pa.string())]))

    def run(batches):
        for batch in batches:
            rows = [
                [dict(zip(("start", "kind", "end", "path"), f)) for f in secrets(t or "", most, altogether)]
                for t in batch.column(column).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, found)], names=[*batch.schema.names, "found"])

    schema = T.StructType([*thin.schema.fields, T.StructField("found", T._parse_datatype_string(FIND))])
    out = thin.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], F.col("found").alias(into))


def base_finds(found: Column) -> Column:
    return F.filter(found, lambda f: f["path"] == "")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")


def span_list(found: Column) -> Column:
    """``kind:start:end`` of sorted finds, joined by commas."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with every find masked; finds that overlap become one mask."""
    t = F.col("`_fw_text`")

    def step(a: Column, f: Column) -> Column:
        fresh = f["start"] >= a["at"]
        piece = F.when(fresh, F.concat(F.substring(t, a["at"] + 1, f["start"] - a["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.concat(a["out"], piece).alias("out"), F.greatest(a["at"], f["end"]).alias("at"))

    kept = [f"c{k}" for k in range(len(docs.columns))]
    thin = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, kept)], whole(F.col(f"`{text}`")).alias("_fw_text"))
    found = scan(thin, "_fw_text", "_fw_found")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    new = F.aggregate("_fw_found", start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    masked = F.when(F.size("_fw_found") > 0, new)
    return found.select(*[(F.coalesce(masked, F.col(k)) if c == text else F.col(k)).alias(c) for c, k in zip(docs.columns, kept)])
