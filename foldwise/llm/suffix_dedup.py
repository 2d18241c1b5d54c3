"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts at another place of the
corpus.  Such a string chooses its own anchor: the smallest hash of a 16-byte gram inside it.
Equal strings choose equal anchors, so only anchored stretches have to meet, and no repeat is
missed.  The steps:

1. every text is cut into stretches of consecutive window starts with the same anchor and the same
   class of distance to it; all windows of a stretch share a core, whose hash is its key;
2. keys that occur once hold no repeat; keys whose stretches are byte for byte equal are repeats;
3. of the other keys each different stretch is fetched once and sent to the key's partition, where
   batches get suffix arrays that start from the cores, meet the levels built so far and merge with
   levels of their size; equal windows of different stretches are found there;
4. a key with very many different stretches (a passage in a large part of all documents) goes the
   same way after its stretches are cut into narrower classes, in the end single windows, which are
   only counted: no partition has to hold such a key.

Equal texts are one text that occurs several times, and all joins are on the text's 128-bit key.
Defined results: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows are
copies of each other; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.text import small_batches, text_key, whole
from foldwise.session import materialize

LENGTH = 400
GRAM = 16
WIDTH = 192
NARROW = 12
MANY = 2000
FAMILY_BYTES = 8 << 20
BLOCK = 1 << 22
STRETCH = "key long, tid binary, sup long, start int, n int, off int"


def stretches(data: bytes, length: int = LENGTH, width: int = WIDTH):
    """Arrays ``(key, sup, start, n, off)`` of the stretches of window starts, block by block: core hash, hash of all
    the bytes, first start, number, and where the core begins in the stretch."""
    import numpy as np
    from xxhash import xxh3_64_intdigest, xxh64_intdigest

    total = len(data) - length + 1
    reach = length - GRAM + 1
    for first in range(0, max(total, 0), BLOCK):
        windows = min(BLOCK, total - first)
        b = np.frombuffer(data, np.uint8, windows + length - 1, first)
        u = np.ndarray((len(b) - 7,), dtype="<u8", buffer=b, strides=(1,))
        x = u[:-8] * np.uint64(0x9E3779B97F4A7C15)
        y = u[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= y >> np.uint64(31)
        y <<= np.uint64(33)
        x ^= y
        x *= np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(29)
        grams = len(x)
        x &= ~np.uint64((1 << 24) - 1)
        x |= np.arange(grams, dtype=np.uint64)
        rows = -(-grams // reach)
        padded = np.full(rows * reach, np.iinfo(np.uint64).max, np.uint64)
        padded[:grams] = x
        grid = padded.reshape(rows, reach)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:windows], ahead[reach - 1 : reach - 1 + windows])
        turn = np.flatnonzero(least[1:] != least[:-1]) + 1
        begin, end = np.concatenate([[0], turn]), np.concatenate([turn, [windows]])
        anchor = (least[begin] & np.uint64((1 << 24) - 1)).astype(np.int64)
        # a run of windows with one anchor is cut where the class of its distance falls by one
        top = (anchor - begin) // width
        pieces = top - (anchor - end + 1) // width + 1
        run = np.repeat(np.arange(len(begin)), pieces)
        k = top[run] - (np.arange(len(run)) - (np.cumsum(pieces) - pieces)[run])
        cut = np.maximum(begin[run], anchor[run] - (k + 1) * width + 1)
        sizes = np.diff(np.concatenate([cut, [windows]]))
        s, a = cut + first, anchor[run] + first
        core = a - k * width
        keys = [xxh64_intdigest(data[x : x + length + 1 - width], y) for x, y in zip(core.tolist(), k.tolist(), strict=True)]
        sups = [xxh3_64_intdigest(data[x:y], z) for x, y, z in zip(s.tolist(), (s + sizes + (length - 1)).tolist(), (a - s).tolist(), strict=True)]
        yield np.array(keys, np.uint64).view(np.int64), np.array(sups, np.uint64).view(np.int64), s, sizes, core - s


def _batch(rows: list, schema: T.StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(cols, schema, strict=True)], names=schema.names)


def _schema(df: DataFrame, ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _cut(texts: DataFrame, length: int, width: int) -> DataFrame:
    schema = _schema(texts, STRETCH)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def send(tids, parts, rows):
            key, sup, start, n, off = (np.concatenate(x) for x in zip(*parts, strict=True))
            of = tids.take(pa.array(np.concatenate(rows)))
            cols = [pa.array(key), of, pa.array(sup), *[pa.array(x.astype(np.int32)) for x in (start, n, off)]]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for b in batches:
            tids, parts, rows, size = b.column(0), [], [], 0
            for i, text in enumerate(b.column(1)):
                for part in stretches(text.as_buffer().to_pybytes(), length, width):
                    parts.append(part)
                    rows.append(np.full(len(part[0]), i))
                    size += len(part[0])
                    if size > 50_000:
                        yield send(tids, parts, rows)
                        parts, rows, size = [], [], 0
            if size:
                yield send(tids, parts, rows)

    return texts.filter(F.octet_length("bytes") >= length).mapInArrow(run, schema)


def _keys(found: DataFrame) -> DataFrame:
    """Keys that occur twice or more and whether their stretches differ."""
    k = found.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("sup").alias("low"), F.max("sup").alias("high")).filter("times > 1")
    return k.select("key", (F.col("low") != F.col("high")).alias("differ"))


def _fetch(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted stretches: ``key, sup, n, off, times, piece``; one document of each text is opened."""
    one = texts.groupBy("tid").agg(F.min("doc").alias("doc"))
    per = wanted.groupBy("tid").agg(F.collect_list(F.struct("key", "sup", "start", "n", "off", "times")).alias("all")).join(one, "tid")
    both = texts.withColumnRenamed("tid", "t").withColumnRenamed("doc", "d").join(per, (F.col("t") == F.col("tid")) & F.col("d").eqNullSafe(F.col("doc")))
    return both.select("bytes", F.explode("all").alias("s")).select(
        "s.key", "s.sup", "s.n", "s.off", "s.times", F.expr(f"substring(bytes, s.start + 1, s.n + {length - 1})").alias("piece")
    )


RUNS = "key long, sup long, runs array<struct<a: int, b: int>>"


def _runs(flags) -> list[dict]:
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _search(pieces: DataFrame, length: int, parts: int) -> DataFrame:
    """Runs of repeated windows per stretch, from the families of suffix arrays of the keys' partitions."""
    schema = _schema(pieces, RUNS)
    thin = pieces.select("key", "sup", "n", "off", "times", "piece").repartition(parts, "key").sortWithinPartitions("key")

    def run(batches):
        import numpy as np

        from foldwise.llm.suffix_levels import Family

        family, seen, meta, total, found = Family(length), set(), [], 0, []
        for b in batches:
            new = []
            for key, sup, n, off, times, piece in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (key, sup) in seen:
                    continue
                seen.add((key, sup))
                new.append((piece, n, total, times, off))
                meta.append((key, sup, total, n))
                total += n
            if new:
                found.append(family.add(new))
        flags = np.zeros(total, bool)
        for f in found:
            flags[f] = True
        rows = [(key, sup, _runs(flags[i : i + n])) for key, sup, i, n in meta]
        yield _batch([r for r in rows if r[2]], schema)

    return thin.mapInArrow(run, schema)


def _narrow(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """The pieces' own stretches of a narrower class: ``key, sup, n, off, times, piece`` and where they come from."""
    schema = _schema(pieces, "key long, sup long, n int, off int, times long, piece binary, p_key long, p_sup long, p_at int")

    def run(batches):
        for b in batches:
            rows = []
            for key, sup, _, times, piece in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for part in stretches(piece, length, width):
                    for k2, s2, s, n, off in zip(*[x.tolist() for x in part], strict=True):
                        rows.append((k2, s2, n, off, times, piece[s : s + n + length - 1] if width > 1 else b"", key, sup, s))
            yield _batch(rows, schema)

    return pieces.select("key", "sup", "n", "times", "piece").mapInArrow(run, schema)


def _crowded(pieces: DataFrame, length: int, width: int, many: int) -> DataFrame:
    """Runs for the pieces of keys with many different stretches, through narrower classes; single windows are counted."""
    cut = materialize(_narrow(pieces, length, width))
    sums = cut.groupBy("key").agg(F.sum("times").alias("t"), F.min("sup").alias("low"), F.max("sup").alias("high"), F.count(F.lit(1)).alias("c")).filter("t > 1")
    kinds = materialize(sums.select("key", ((F.col("low") != F.col("high")) & F.lit(width > 1)).alias("differ"), "c"))
    all_of = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    known = cut.drop("piece").join(kinds, "key")
    out = known.filter("not differ").select("p_key", "p_sup", "p_at", all_of.alias("runs"))
    if width > 1:
        mixed = cut.join(kinds.filter("differ"), "key")
        one = mixed.groupBy("key", "sup", "n", "off", "piece", "c").agg(F.sum("times").alias("times"))
        found = _runs_of(one, length, many, 1).withColumnRenamed("runs", "r")
        twice = one.filter("times > 1").select("key", "sup", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("r"))
        found = found.unionByName(twice).groupBy("key", "sup").agg(F.flatten(F.collect_list("r")).alias("r"))
        out = out.unionByName(mixed.join(found, ["key", "sup"]).select("p_key", "p_sup", "p_at", F.col("r").alias("runs")))
    moved = out.select(
        F.col("p_key").alias("key"), F.col("p_sup").alias("sup"),
        F.transform("runs", lambda r: F.struct((r["a"] + F.col("p_at")).alias("a"), (r["b"] + F.col("p_at")).alias("b"))).alias("runs"),
    )
    return moved.groupBy("key", "sup").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _runs_of(pieces: DataFrame, length: int, many: int, width: int) -> DataFrame:
    """Runs per stretch of pieces that have ``c``, the number of different stretches of their key."""
    size = pieces.filter(F.col("c") <= many).agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    spark = pieces.sparkSession
    parts = max(-(-size // FAMILY_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (1 << 18))), 1)
    found = _search(pieces.filter(F.col("c") <= many), length, parts)
    crowd = pieces.filter(F.col("c") > many)
    if crowd.limit(1).count():
        found = found.unionByName(_crowded(crowd, length, width, many))
    return found


def repeats(texts: DataFrame, length: int = LENGTH, width: int = WIDTH, many: int = MANY) -> DataFrame:
    """``(tid, spans)`` of texts that hold repeated bytes: pieces of the removed spans, unordered, ends exclusive.

    ``texts`` has ``tid`` (128-bit key), ``doc`` and ``bytes``, one row per document.
    """
    small_batches(texts.sparkSession)
    found = materialize(_cut(texts.select("tid", "bytes"), length, width))
    # the keys are a table of their own and the groups leave out the key, which their columns determine:
    # nothing but shuffles or a broadcast of checked size meets in the join, so a hot key may be split
    hits = materialize(found.join(materialize(_keys(found)), "key").groupBy("tid", "sup", "start", "n", "off").agg(
        F.min("key").alias("key"), F.max("differ").alias("differ"), F.count(F.lit(1)).alias("times")
    ))
    mixed = hits.filter("differ")
    one = mixed.groupBy("key", "sup").agg(F.min(F.struct("tid", "start", "n", "off")).alias("w"), F.sum("times").alias("times"))
    crowd = one.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    wanted = one.select("key", "sup", "w.tid", "w.start", "w.n", "w.off", "times")
    pieces = materialize(_fetch(texts, wanted, length).dropDuplicates(["key", "sup"]).join(crowd, "key"))
    runs = materialize(_runs_of(pieces, length, many, NARROW))
    whole_run = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    every = hits.filter("not differ").select("tid", "start", whole_run.alias("runs"))
    every = every.unionByName(mixed.join(runs, ["key", "sup"]).select("tid", "start", "runs"))
    span = F.explode(F.transform("runs", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + (length - 1)).alias("b"))))
    return every.select("tid", span.alias("s")).groupBy("tid").agg(F.collect_list("s").alias("spans"))


def text_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("doc"), text_key(F.col(f"`{text}`")).alias("tid"), F.encode(whole(F.col(f"`{text}`")), "UTF-8").alias("bytes"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, width: int = WIDTH, many: int = MANY) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: maximal removed runs (byte offsets, ends exclusive) and the bytes that stay."""
    texts = text_rows(docs, doc_id, text)
    marked = texts.join(repeats(texts, length, width, many), "tid", "left")
    schema = T.StructType([
        T.StructField("doc_id", texts.schema["doc"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes, spans, kept = [], [], []
            for data, s in zip(b.column(1), b.column(2), strict=True):
                raw = data.as_buffer().to_pybytes()
                merged: list = []
                for x in sorted((x["a"], x["b"]) for x in s.as_py() or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                ends = [0, *[e for m in merged for e in m], len(raw)]
                sizes.append(len(raw))
                spans.append([{"a": a, "b": e} for a, e in merged])
                kept.append(b"".join(raw[a:e] for a, e in zip(ends[::2], ends[1::2], strict=True)) if merged else raw)
            kinds = [pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip((sizes, spans, kept), kinds, strict=True)]], names=schema.names)

    return marked.select("doc", "bytes", "spans").mapInArrow(run, schema)
