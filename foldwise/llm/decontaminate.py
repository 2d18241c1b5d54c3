"""Benchmark decontamination: pigeonhole pieces, exact hits, then Myers' bit-parallel distance.

A test item with an error budget of k edits is cut into k + 1 pieces; a passage within k edits
holds at least one piece unchanged.  All pieces are searched at once in every whole text, and the
text around a hit is compared with the item by bit-parallel dynamic programming.  Items are read
in blocks of bounded bytes; each block goes to the tasks that scan the documents, which are never
shuffled.

Text is compared in lower case with each run of white space as one space.  Defined results: null
and blank texts and items match nothing; repeated documents or items give repeated rows; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.text import small_batches
from foldwise.session import materialize

ERRORS = 0.08
BLOCK_BYTES = 8 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, errors: float = ERRORS) -> int:
    return int(len(item) * errors)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 adjacent pieces of about equal length with their offsets."""
    cut = [round(j * len(item) / (k + 1)) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def alphabet(item: str) -> dict[str, int]:
    """For every character the bits of its places in the item."""
    out: dict[str, int] = {}
    for j, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << j
    return out


def myers(places: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance between the item and any part of the text, and where the first such part ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Searcher:
    """One block of items, ready to scan texts."""

    def __init__(self, items: list[tuple[int | None, str]], errors: float = ERRORS):
        import ahocorasick

        self.items = [(i, t, budget(t, errors), alphabet(t)) for i, t in ((i, normal(t)) for i, t in items) if t]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _) in enumerate(self.items):
            for off, p in pieces(t, k):
                found.setdefault(p, []).append((n, off))
        self.words = ahocorasick.Automaton()
        for p, where in found.items():
            self.words.add_word(p, (len(p), where))
        if found:
            self.words.make_automaton()

    def scan(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item id, distance, end of the passage) for every item within its budget."""
        t = normal(text)
        if not t or not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for last, (size, where) in self.words.iter(t):
            for n, off in where:
                starts.setdefault(n, set()).add(last + 1 - size - off)
        out = []
        for n, at in sorted(starts.items()):
            item_id, item, k, places = self.items[n]
            whole = t.find(item)
            if whole >= 0:
                out.append((item_id, 0, whole + len(item)))
                continue
            best = None
            for lo, hi in _spans(sorted(at), 2 * k):
                a = max(0, lo - k)
                d, end = myers(places, len(item), t[a : hi + len(item) + k])
                if d <= k and (best is None or d < best[0]):
                    best = (d, a + end)
            if best:
                out.append((item_id, *best))
        return out


def _spans(starts: list[int], gap: int):
    """Runs of possible starts that lie close together."""
    lo = hi = starts[0]
    for s in starts[1:]:
        if s - hi > gap:
            yield lo, hi
            lo = s
        hi = s
    yield lo, hi


def _blocks(items: DataFrame, item_id: str, text: str, limit: int):
    """(items, is there only this one) of blocks of about ``limit`` bytes, read one after the other."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    n = -(-size // limit) or 1
    for b in range(n):
        got = items.filter(F.pmod(F.xxhash64(F.col(item_id), F.col(text)), F.lit(n)) == b).select(item_id, text).collect()
        yield sorted(((r[0], r[1]) for r in got if r[1]), key=lambda r: (r[0] is None, r[0], r[1])), n == 1


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
            errors: float = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, distance, passage_end)`` for every document and item whose passage it holds."""
    small_batches(docs.sparkSession)
    thin = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", thin.schema["doc_id"].dataType), T.StructField("item_id", items.schema[item_id].dataType),
        T.StructField("distance", T.IntegerType()), T.StructField("passage_end", T.LongType()),
    ])

    def scanner(block):
        def run(batches):
            import pyarrow as pa

            search = Searcher(block, errors)
            for b in batches:
                rows = [(d.as_py(), *m) for d, t in zip(b.column(0), b.column(1), strict=True) for m in search.scan(t.as_py())]
                cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                types = [b.column(0).type, None, pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty or pa.int64()) for c, ty in zip(cols, types, strict=True)], names=schema.names)

        return run

    out = None
    for block, alone in _blocks(items, item_id, item_text, block_bytes):
        part = thin.mapInArrow(scanner(block), schema)
        # a block's items leave the driver with its stored result
        part = part if alone else materialize(part)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", errors: float = ERRORS,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no passage of any item, in their own partitions and with their columns as they were."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def keeper(block):
        def run(batches):
            import pyarrow as pa

            search = Searcher(block, errors)
            for b in batches:
                yield b.filter(pa.array([not search.scan(t.as_py()) for t in b.column(at)], pa.bool_()))

        return run

    out = docs
    for block, alone in _blocks(items, item_id, item_text, block_bytes):
        out = out.mapInArrow(keeper(block), docs.schema)
        out = out if alone else materialize(out)
    return out
