"""Conversation structure repair: weighted interval parsing of turns into ``(s?(ua)+)?``.

Role initials must read as an optional system turn and then user/assistant pairs.  The repair
grammar is in Chomsky normal form.  Its symbols are fragments ``(p, q)`` that lead from one mark
to another (nothing yet, after s, after u, after a); its binary rules put two fragments that meet
at a mark together, ``(p, q) -> (p, r) (r, q)``; its unary rules read one row by an edit (Keep,
Rerole, Delete).  A span of rows has a cell: for every symbol the least (cost, audit) pair, audits
compared as ASCII.  Inserted turns belong to the empty span, whose cell (the insertion closure)
is put on both sides of every row's cell, so that all larger cells are closed as well.

Cells are filled bottom-up by span length: 1, 2, 4, ...  As a fragment carries both its ends, every
split of a span gives the same cell, so one split per span is enough and a conversation of n rows
takes n - 1 combinations.  Equal costs never compare an audit with its own prefix (a span's
audits hold one letter per row, and an insertion more costs more), so the least concatenation is
that of the least parts.

Spark spreads the rows by range of (conversation, turn, role, text key): a conversation that holds
a third of all rows becomes many spans, one per task, and only their cells meet again.  Texts
take no part in the parsing; they are read once more, in order and as a stream, when the repaired
rows are written.

Defined results: a null role or text is one space; a null conversation id is a conversation of its
own; rows go by turn (nulls first), then role, then the text's key, so ties do not depend on the
input's order; repeated rows are duplicates; an empty table gives an empty table; further columns
play no part.  Roles count by their first character.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.text import SPACE, small_batches
from foldwise.session import materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
# Marks: 0 nothing yet, 1 after s, 2 after u, 3 after a.  One step reads one role initial.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
COMPLETE = ((0, 0), (0, 3))
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
MEMO = 4

Cell = dict


def _symbols() -> list[tuple[int, int]]:
    reach = {(p, p) for p in range(4)} | {(p, q) for (p, _), q in STEPS.items()}
    while True:
        more = reach | {(p, s) for p, q in reach for r, s in reach if q == r}
        if more == reach:
            return sorted(reach)
        reach = more


SYMBOLS = _symbols()
# Binary rules as (whole, first, second).
RULES = [((p, q), (p, r), (r, q)) for p, r in SYMBOLS for r2, q in SYMBOLS if r == r2]


def combine(left: Cell, right: Cell) -> Cell:
    """Cell of two spans side by side."""
    out: Cell = {}
    for whole, first, second in RULES:
        a, b = left.get(first), right.get(second)
        if a is None or b is None:
            continue
        cost, best = a[0] + b[0], out.get(whole)
        if best is None or cost < best[0]:
            out[whole] = (cost, a[1] + b[1])
        elif cost == best[0]:
            audit = a[1] + b[1]
            if audit < best[1]:
                out[whole] = (cost, audit)
    return out


def _least(pairs) -> Cell:
    out: Cell = {}
    for symbol, value in pairs:
        out[symbol] = min(out.get(symbol, value), value)
    return out


@lru_cache(maxsize=1)
def inserted() -> Cell:
    """Cell of the empty span: nothing, or inserted user and assistant turns."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    one = _least(((p, q), (COSTS[INSERT], INSERT)) for (p, c), q in STEPS.items() if c in NAMES)
    while True:
        longer = combine({**one, **{(p, p): (0, "") for p in range(4)}}, cell)
        if longer == cell:
            return cell
        cell = longer


@lru_cache(maxsize=64)
def row_cell(code: str) -> Cell:
    """Cell of one row.  Codes: x must go; s, u, a, o (another role) by initial, upper case if truncated."""
    pairs = [((p, p), (COSTS[DELETE], DELETE)) for p in range(4)]
    if code != "x":
        extra = TRUNCATED if code.isupper() else 0
        for (p, c), q in STEPS.items():
            if c == code.lower():
                pairs.append(((p, q), (COSTS[KEEP] + extra, KEEP)))
            if c in NAMES:
                pairs.append(((p, q), (COSTS[REROLE] + extra, REROLE)))
    return combine(combine(inserted(), _least(pairs)), inserted())


@lru_cache(maxsize=100_000)
def _short(codes: str) -> Cell:
    if len(codes) == 1:
        return row_cell(codes)
    half = len(codes) // 2
    return combine(_short(codes[:half]), _short(codes[half:]))


def fold(cells: list[Cell]) -> Cell:
    """One cell for spans side by side, neighbours put together by rising length."""
    while len(cells) > 1:
        pairs = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[len(cells) // 2 * 2:]
    return cells[0] if cells else inserted()


def parse(codes: str) -> Cell:
    """Cell of a span of rows; cells of up to ``MEMO`` rows are remembered by their codes."""
    return fold([_short(codes[k:k + MEMO]) for k in range(0, len(codes), MEMO)])


def power(code: str, n: int) -> Cell:
    """Cell of ``n`` rows with the same code, by doubling."""
    if n == 1:
        return row_cell(code)
    half = power(code, n // 2)
    twice = combine(half, half)
    return combine(twice, row_cell(code)) if n % 2 else twice


class Span:
    """A growing span: settled cells and the codes that wait to become one."""

    def __init__(self, first: str):
        self.first = self.last = first
        self.cells, self.codes, self.illegal = [], [], 0

    def add(self, initial: str, code: str, n: int, begin: bool) -> None:
        """``n`` equal rows: the further copies are duplicates, or blank like the first."""
        self.illegal += (not begin and self.last + initial not in LEGAL) + (n - 1) * (initial * 2 not in LEGAL)
        self.last = initial
        self.codes.append(code)
        if n <= 64:
            self.codes.append("x" * (n - 1))
        else:
            self.settle()
            self.cells.append(power("x", n - 1))
        if len(self.codes) > 8192:
            self.settle()

    def settle(self) -> None:
        if self.codes:
            self.cells.append(parse("".join(self.codes)))
            self.codes = []

    def cell(self) -> Cell:
        self.settle()
        return fold(self.cells)


def answer(cell: Cell) -> tuple[int, str]:
    return min(cell[s] for s in COMPLETE if s in cell)


# ---- rows --------------------------------------------------------------------------------------

def conversation_key(conv: str) -> Column:
    """Key that also stands for the missing id."""
    return F.coalesce(F.concat(F.lit("c"), F.col(f"`{conv}`").cast("string")), F.lit("n"))


def _text_columns(conv: str, turn: str, role: str, text: str) -> list[Column]:
    r, t = F.coalesce(F.col(f"`{role}`"), F.lit(" ")), F.coalesce(F.col(f"`{text}`"), F.lit(" "))
    return [conversation_key(conv).alias("k"), F.col(f"`{turn}`").alias("turn"), r.alias("role"), F.unhex(F.md5(t)).alias("tk"), t.alias("text")]


def distinct_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  present: str | None = None) -> DataFrame:
    """Thin rows (c, k, turn, role, tk, n, blank, cut, again): one per different row, ``n`` of them in the input.

    ``again``: its role and text were seen at an earlier turn.  Rows that are not ``present`` name
    their conversation only and have n = 0.
    """
    here = F.col(f"`{present}`") if present else F.lit(True)
    tail = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    full = rows.select(F.col(f"`{conv}`").alias("c"), *_text_columns(conv, turn, role, text), F.coalesce(here, F.lit(False)).alias("here"))
    only = lambda x: F.when(F.col("here"), x)
    thin = full.select(
        "c", "k", only(F.col("turn")).alias("turn"), only(F.col("role")).alias("role"), only(F.col("tk")).alias("tk"),
        only(tail == "").alias("blank"), only(~tail.isin("", ".", "!", "?")).alias("cut"), "here",
    )
    by = ["c", "k", "turn", "role", "tk"]
    one = materialize(thin.groupBy(*by).agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.count_if("here").alias("n")))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = one.filter("n > 0").groupBy("k", "role", "tk").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1")
    return one.join(first.select("k", "role", "tk", "first"), ["k", "role", "tk"], "left").select(
        "c", "k", "turn", "role", "tk", "n", "blank", "cut",
        (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(at)).alias("again"),
    )


SEGMENT = "k string, seg int, whole boolean, cost long, audit string, illegal long, first string, last string, cell array<struct<p:int,q:int,cost:long,audit:string>>"


def _packed(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": v[0], "audit": v[1]} for (p, q), v in cell.items()]


def _segments(batches):
    """Spans of conversations in one sorted partition.  Only the first and the last may go on elsewhere; the others are settled here."""
    key = span = None
    place, opening, out = 0, True, []
    types = pa.schema([
        ("k", pa.string()), ("seg", pa.int32()), ("whole", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()),
        ("first", pa.string()), ("last", pa.string()),
        ("cell", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ])

    def close(whole: bool) -> dict:
        cell = span.cell()
        cost, audit = answer(cell) if whole else (None, None)
        return {"k": key, "seg": place, "whole": whole, "cost": cost, "audit": audit, "illegal": span.illegal, "first": span.first,
                "last": span.last, "cell": None if whole else _packed(cell)}

    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("k", "seg", "initial", "code", "n")]
        for k, place, initial, code, n in zip(*cols):  # noqa: B020
            begin = k != key
            if begin:
                if span is not None:
                    out.append(close(not opening))
                    opening = False
                key, span = k, Span(initial)
            span.add(initial, code, n, begin)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)
            out = []
    if span is not None:
        yield pa.RecordBatch.from_pylist([close(False)], schema=types)


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Settle a conversation whose spans lie in several partitions (or at a border)."""
    pdf = pdf.sort_values("seg")
    cell = fold([{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cells} for cells in pdf["cell"]])
    cost, audit = answer(cell)
    borders = sum(a + b not in LEGAL for a, b in zip(pdf["last"], pdf["first"].iloc[1:]))
    return pd.DataFrame([{"k": pdf["k"].iloc[0], "cost": cost, "audit": audit, "illegal": int(pdf["illegal"].sum()) + borders}])


def verdicts(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             present: str | None = None) -> DataFrame:
    """One row per conversation: conv_id (as ``conv``), _fw_key, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    thin = materialize(distinct_rows(rows, conv, turn, role, text, present))
    n, fresh = F.col("n"), ~F.col("blank") & ~F.col("again")
    turns = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    counts = thin.groupBy("c", "k").agg(
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("blank"), n)), F.lit(0)).alias("blank"),
        F.coalesce(F.sum(F.when(~F.col("blank"), n - 1 + F.col("again").cast("int"))), F.lit(0)).alias("duplicate"),
        F.count_if(fresh & F.col("cut")).alias("truncated"),
    )
    start = F.substring("role", 1, 1)
    initial = F.when(start.isin("s", "u", "a"), start).otherwise("o")
    code = F.when(~fresh, F.lit("x")).when(F.col("cut"), F.upper(initial)).otherwise(initial)
    order = ["k", "turn", "role", "tk"]
    spread = thin.filter("n > 0").select(*order, initial.alias("initial"), code.alias("code"), "n").repartitionByRange(*order)
    sorted_rows = spread.sortWithinPartitions(*order).select("k", F.spark_partition_id().alias("seg"), "initial", "code", "n")
    spans = materialize(sorted_rows.mapInArrow(_segments, SEGMENT))
    settled = spans.filter("whole").select("k", "cost", "audit", "illegal")
    met = spans.filter("not whole").groupBy("k").applyInPandas(_meet, "k string, cost long, audit string, illegal long")
    parsed = settled.unionByName(met)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return counts.join(parsed, "k", "left").select(
        F.col("c").alias(conv), F.col("k").alias("_fw_key"), zero("gaps"), zero("blank"), zero("duplicate"), zero("truncated"),
        zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
    )


class Edits:
    """The edits of one conversation, row by row; positions and roles follow from the audit alone."""

    def __init__(self, audit: str):
        self.audit, self.at, self.out = audit, 0, 0
        self.odd = (len(audit) - audit.count(DELETE)) % 2

    def _role(self) -> str:
        return "user" if (self.out - self.odd) % 2 == 0 else "assistant"

    def inserts(self):
        """(position, role, text) of the turns inserted here."""
        while self.audit[self.at:self.at + 1] == INSERT:
            yield self.out, self._role(), ""
            self.at, self.out = self.at + 1, self.out + 1

    def row(self, role: str, text: str):
        """What becomes of the next row, after the turns inserted before it."""
        yield from self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != DELETE:
            yield self.out, role if edit == KEEP else self._role(), text
            self.out += 1


def _in_order(rows: DataFrame, found: DataFrame, conv, turn, role, text, present) -> DataFrame:
    """Audits and texts of each conversation in one task, the audit first, then the rows in the order of the parsing."""
    small_batches(rows.sparkSession)
    here = rows.filter(F.coalesce(F.col(f"`{present}`"), F.lit(False))) if present else rows
    texts = here.select(*_text_columns(conv, turn, role, text), F.lit(1).alias("kind"))
    heads = found.select(F.col("_fw_key").alias("k"), "audit", F.lit(0).alias("kind"))
    both = heads.unionByName(texts, allowMissingColumns=True)
    return both.repartition("k").sortWithinPartitions("k", "kind", "turn", "role", "tk").select("k", "kind", "audit", "role", "text")


def _conversations(batches):
    """(key, None) at a conversation's start, (key, turns) for each row, (key, last turns) at its end; holds one row at a time."""
    key = edits = None
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("k", "kind", "audit", "role", "text")]
        for k, kind, audit, role, text in zip(*cols):
            if kind == 0:
                if edits is not None:
                    yield key, edits.inserts(), True
                key, edits = k, Edits(audit)
            else:
                yield key, edits.row(role, text), False
    if edits is not None:
        yield key, edits.inserts(), True


def digests(rows: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            present: str | None = None) -> DataFrame:
    """(_fw_key, repaired_sha256): SHA-256 of each repaired conversation's ``role:text`` lines.

    A digest is sequential, so a conversation is read by one task, as a stream.
    """

    def run(batches):
        state, fresh, out = hashlib.sha256(), True, []
        types = pa.schema([("_fw_key", pa.string()), ("repaired_sha256", pa.string())])
        for key, turns, last in _conversations(batches):
            for _, who, said in turns:
                state.update(("" if fresh else "\n").encode() + f"{who}:{said}".encode("utf-8", "surrogatepass"))
                fresh = False
            if last:
                out.append({"_fw_key": key, "repaired_sha256": state.hexdigest()})
                state, fresh = hashlib.sha256(), True
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=types)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=types)

    return _in_order(rows, found, conv, turn, role, text, present).mapInArrow(run, "_fw_key string, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: str | None = None) -> DataFrame:
    """The repaired conversations: ``conv``, position, role, text; inserted turns have the empty text."""
    found = materialize(verdicts(rows, conv, turn, role, text, present))

    def run(batches):
        out, size = [], 0
        types = pa.schema([("k", pa.string()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        for key, turns, _ in _conversations(batches):
            for at, who, said in turns:
                out.append({"k": key, "position": at, "role": who, "text": said})
                size += len(said) + 50
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=types)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=types)

    made = _in_order(rows, found, conv, turn, role, text, present).mapInArrow(run, "k string, position long, role string, text string")
    ids = found.select(F.col("_fw_key").alias("k"), F.col(f"`{conv}`"))
    return made.join(ids, "k").select(F.col(f"`{conv}`"), "position", F.col("role").alias(role), F.col("text").alias(text))


# ---- the damage of the query -------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by the CRC of ``conv_id:turn``: dropped (``here`` false), emptied, unpunctuated, repeated or reroled."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    copies = F.explode(F.array_repeat(hit != 0, F.when(hit == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(hit == 4, F.lit("user")).otherwise(text_of("role")).alias("role"), text.alias("text"), copies.alias("here"))
