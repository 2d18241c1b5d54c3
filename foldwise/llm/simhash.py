"""SimHash near-duplicates: pigeonhole blocks, a join on them, then the Hamming distance.

Fingerprints are computed where the text is read; from there on only distinct 64-bit values
travel.  They are split into blocks such that two values with few differing bits agree on
some of them; values that agree are joined and verified.  A block value that many fingerprints
share (a large group of near copies) is not joined with itself: its members meet at the values
that lie half the distance away, where at most a few thousand can meet and all of them are
linked, so the links stay linear in the members and none is lost.  Half way means 65 or 2,081 rows
for each member, so block values with up to ``FEW`` members are compared directly instead.

Defined results: a null or blank text has fingerprint zero, which is linked like any other;
repeated rows share a fingerprint; null ids take part but never name a component that holds a
numbered document; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.graph import components
from foldwise.llm.text import small_batches
from foldwise.session import materialize

BITS = 64
SEED = 42
FEW = 2048
WORDS = 3
LINK_TYPE = "a long, b long"


def text_fingerprint(text: str | None, words: int, distinct: bool = False, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of a text's word shingles (ASCII case folded), zero without words."""
    import numpy as np
    from xxhash import xxh64_intdigest as hashed

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(words, len(parts))
    cut = zip(starts[: len(parts) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    if distinct:
        values = [hashed(x, seed) for x in {joined[s:e] for s, e in cut}]
    else:
        values = [hashed(joined[s:e], seed) for s, e in cut]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(values), 1 << 16):
        h = np.array(values[k : k + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingles: dict[str, tuple], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and one long column per entry of ``shingles``: name -> (words per shingle, distinct shingles only, seed)."""
    small_batches(docs.sparkSession)
    thin = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_fw_text"))
    out = T.StructType([*thin.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in shingles]])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(b.num_columns - 1)
            cols = [[text_fingerprint(t.as_py(), *how) for t in texts] for how in shingles.values()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, pa.int64()) for c in cols]], names=out.names)

    return thin.mapInArrow(run, out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_keys(fp: Column, max_bits: int, blocks: int) -> Column:
    """Hashes of every choice of ``blocks - max_bits`` blocks: close fingerprints share at least one."""
    at = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(at, at[1:], strict=False)]
    return F.array(*[
        F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(_signed(sum(chosen))).cast("long"))) for i, chosen in enumerate(combinations(masks, blocks - max_bits))
    ])


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _near(fp: Column, radius: int) -> Column:
    """All values within ``radius`` bits of a fingerprint."""
    flips = [0]
    for r in range(1, radius + 1):
        flips += [sum(1 << k for k in c) for c in combinations(range(BITS), r)]
    return F.transform(F.array(*[F.lit(_signed(x)).cast("long") for x in flips]), lambda x: fp.bitwiseXOR(x))


def _forests(lists: DataFrame, most: int) -> DataFrame:
    """Links of a spanning forest of every list's pairs within ``most`` bits: at most one per member.

    Each value in turn takes all values near it out of those left, so a list costs at most the square
    of its length in comparisons and far less where its values are alike.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for values in b.column(0):
                left = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
                while left.size > 1:
                    front, left = [left[0]], left[1:]
                    while front and left.size:
                        x = front.pop()
                        near = np.bitwise_count(left ^ x) <= most
                        if near.any():
                            found = left[near]
                            left = left[~near]
                            starts.append(np.full(found.size, x))
                            ends.append(found)
                            front.extend(found)
            cols = [pa.array(np.concatenate(c).view(np.int64)) for c in (starts, ends)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b"])

    return lists.mapInArrow(run, LINK_TYPE)


def links(values: DataFrame, max_bits: int = 2, blocks: int = 5, few: int = FEW) -> DataFrame:
    """Links ``(a, b)`` that join the same fingerprints as all pairs within ``max_bits`` (an even number) would.

    ``values`` has one column of distinct fingerprints.  Up to ``few`` values under a block key
    are compared with each other and give a spanning forest; larger keys go through the values half way.
    """
    if max_bits % 2 or not 0 <= max_bits < blocks:
        raise ValueError("max_bits must be even and less than blocks")
    fp = values.columns[0]
    keyed = values.select(F.explode(block_keys(F.col(fp), max_bits, blocks)).alias("key"), F.col(fp).alias("fp"))
    shared = materialize(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key"))
    cold = shared.filter(F.col("n") <= few)
    met_by_key = cold.groupBy("key").agg(F.collect_list("fp").alias("s"))
    two = met_by_key.filter("size(s) = 2").select(F.col("s")[0].alias("a"), F.col("s")[1].alias("b")).filter(differing_bits(F.col("a"), F.col("b")) <= max_bits)
    pairs = two.unionByName(_forests(met_by_key.filter("size(s) > 2").select("s"), max_bits))
    hot = shared.filter(F.col("n") > few).select("fp").distinct()
    met = hot.select("fp", F.explode(_near(F.col("fp"), max_bits // 2)).alias("m")).groupBy("m").agg(F.collect_set("fp").alias("s")).filter("size(s) > 1")
    stars = met.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).filter(
        (F.col("a") != F.col("b")) & (differing_bits(F.col("a"), F.col("b")) <= max_bits)
    )
    return pairs.unionByName(stars).distinct()


def linked(prints: DataFrame, fp: str = "fp", doc_id: str = "doc_id", max_bits: int = 2, blocks: int = 5) -> DataFrame:
    """``(fp, component_id, n_docs)`` per distinct fingerprint; the component is named by its smallest document."""
    distinct = materialize(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least"), F.count(F.lit(1)).alias("n_docs")))
    roots = components(links(distinct.select("fp"), max_bits, blocks)).withColumnRenamed("node", "fp")
    named = materialize(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id", "n_docs")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, max_bits: int = 2, blocks: int = 5) -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``."""
    prints = materialize(fingerprints(docs, {"fp": (words, False)}, text, (doc_id,)))
    return prints.join(linked(prints, "fp", doc_id, max_bits, blocks).drop("n_docs"), "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies, found by linked fingerprints and an exact check (:mod:`near_copies`)."""
    from foldwise.llm import near_copies

    return near_copies.keep_one(docs, doc_id, text)
