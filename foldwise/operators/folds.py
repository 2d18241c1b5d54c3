"""Rolling folds by calendar position, without range joins.

A fold design is a list of (segment, length) laid end to end and a step.  The
folds that a position belongs to follow by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.calendar import check_lengths


class Design:
    """Segments in time order, the step between folds and the first fold number."""

    def __init__(self, name: str, segments, step: int | None = None, first_id: int = 1):
        self.name, self.segments = name, [(s, int(n)) for s, n in segments]
        self.step = int(step) if step is not None else self.segments[-1][1]
        self.first_id = first_id
        check_lengths(step=self.step, **{s: n for s, n in self.segments})
        self.total = sum(n for _, n in self.segments)

    def offset(self, segment: str) -> int:
        at = 0
        for s, n in self.segments:
            if s == segment:
                return at
            at += n
        raise KeyError(segment)

    def length(self, segment: str) -> int:
        return dict(self.segments)[segment]

    def last_fold(self, n_dates: Column) -> Column:
        """0-based number of the last fold that fits (negative: none)."""
        return F.floor((n_dates - self.total) / self.step).cast("long")


def three_segment(selection: int, certification: int, test: int) -> Design:
    return Design("three", [("selection", selection), ("certification", certification), ("test", test)])


def two_segment(training: int, test: int, step: int | None = None, first_id: int = 1) -> Design:
    return Design(str(training), [("training", training), ("test", test)], step, first_id)


def fold_spans(cal_pos: DataFrame, design: Design) -> DataFrame:
    """One row per fold and segment: first and last position and date."""
    n = cal_pos.groupBy("panel_id").agg(F.max("n_dates").alias("n_dates"))
    parts, at = [], 0
    for s, length in design.segments:
        parts.append(F.struct(F.lit(s).alias("segment"), F.lit(at).alias("lo"), F.lit(at + length - 1).alias("hi")))
        at += length
    spans = (
        n.withColumn("k_last", design.last_fold(F.col("n_dates")))
        .filter("k_last >= 0")
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k_last"))))
        .withColumn("part", F.explode(F.array(*parts)))
        .select(
            "panel_id", F.lit(design.name).alias("design"), (F.col("k") + design.first_id).alias("fold_id"),
            F.col("part.segment").alias("segment"),
            (F.col("k") * design.step + F.col("part.lo")).alias("pos_lo"),
            (F.col("k") * design.step + F.col("part.hi")).alias("pos_hi"),
        )
    )
    lo = cal_pos.select("panel_id", F.col("pos").alias("pos_lo"), F.col("dt").alias("dt_lo"))
    hi = cal_pos.select("panel_id", F.col("pos").alias("pos_hi"), F.col("dt").alias("dt_hi"))
    return spans.join(lo, ["panel_id", "pos_lo"]).join(hi, ["panel_id", "pos_hi"])


def fold_calendar(cal_pos: DataFrame, design: Design) -> DataFrame:
    """Folds with one start and end column pair per segment."""
    spans = fold_spans(cal_pos, design)
    aggs = []
    for s, _ in design.segments:
        hit = F.col("segment") == s
        aggs += [
            F.max(F.when(hit, F.col("dt_lo"))).alias(f"{s}_start"),
            F.max(F.when(hit, F.col("dt_hi"))).alias(f"{s}_end"),
        ]
    return spans.groupBy("panel_id", "design", "fold_id").agg(*aggs)


def covering_folds(pos: Column, n_dates: Column, design: Design, offset: int, length: int) -> Column:
    """Array of the fold ids whose window [offset, offset+length) holds ``pos``."""
    first = F.greatest(F.lit(0).cast("long"), F.ceil((pos - (offset + length - 1)) / design.step).cast("long"))
    last = F.least(design.last_fold(n_dates), F.floor((pos - offset) / design.step).cast("long"))
    ids = F.sequence(first + design.first_id, last + design.first_id)
    return F.when(last >= first, ids)


def assign_folds(rows: DataFrame, design: Design, segments=None) -> DataFrame:
    """Copy each positioned row to the folds and segments that use it.

    ``segments`` maps an output name to the design segments it spans, so that a
    development window can be selection and certification together.
    """
    segments = segments or {s: [s] for s, _ in design.segments}
    pieces = []
    for name, members in segments.items():
        lo = min(design.offset(m) for m in members)
        length = sum(design.length(m) for m in members)
        ids = covering_folds(F.col("pos"), F.col("n_dates"), design, lo, length)
        pieces.append(F.struct(F.lit(name).alias("segment"), ids.alias("ids")))
    return (
        rows.withColumn("_piece", F.explode(F.array(*pieces)))
        .withColumn("fold_id", F.explode("_piece.ids"))
        .withColumn("segment", F.col("_piece.segment"))
        .withColumn("design", F.lit(design.name))
        .drop("_piece")
    )
