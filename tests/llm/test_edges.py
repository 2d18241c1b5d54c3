"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from foldwise.llm import decontaminate, html_crf, mixing, pii, preference, quality_rules, simhash, slots, suffix_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _fw_x string, key string, fp string, n string"
LONG = "word " * 60_000
GOOD = "the cat and the dog are in the house of the old man who was with them on that day and they have it for you "
ROWS = [
    (1, None, None, None, None, "a", "b", "c", "d"), (None, "", "en", "s", 0, "a", "b", "c", "d"), (2, LONG, "en", "s", 5, "a", "b", "c", "d"),
    (3, " \n\t ", "en", None, 3, "a", "b", "c", "d"), (4, GOOD * 9, "en", "s", 3, "a", "b", "c", "d"), (4, GOOD * 9, "en", "s", 3, "a", "b", "c", "d"),
    (5, GOOD * 9, "en", "t", 3, "a", "b", "c", "d"), (None, "naïve ünïcode 😀 text " * 30, "en", "t", 3, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def trees(spark):
    return pii.fit(spark, 60)


def ids(df, c="doc_id"):
    return sorted((r[c] is None, r[c] or 0) for r in df.collect())


ALL = sorted((r[0] is None, r[0] or 0) for r in ROWS)


def test_rules(docs, empty):
    assert ids(quality_rules.judge(docs)) == ALL
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {4, 5, None}
    assert quality_rules.keep(empty).count() == 0


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs)
    assert ids(got) == ALL
    by = {(r.doc_id, r.fp): r.component_id for r in got.collect()}
    assert {c for (d, f), c in by.items() if f == 0} == {1}
    assert {c for (d, _), c in by.items() if d in (4, 5)} == {4}
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = [r.doc_id for r in kept.collect()]
    assert found.count(4) == 1 and 5 not in found and 2 in found
    assert simhash.keep_one(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, GOOD * 2), (2, None), (3, ""), (1, GOOD * 2)], "item_id long, text string")
    rows = decontaminate.matches(docs, items).collect()
    assert sorted({(r.doc_id, r.item_id, r.distance) for r in rows}) == [(4, 1, 0), (5, 1, 0)] and len(rows) == 6
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 3
    assert decontaminate.clean(docs, items.filter("false")).count() == len(ROWS)
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.clean(empty, items).count() == 0


def test_preference(spark, docs, empty):
    x = docs.select("doc_id", preference.features().alias("x"))
    labels = spark.createDataFrame([(4, 1, 0), (2, 0, 0), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    model = preference.fit(x, labels)
    scores = [r[0] for r in x.select(model.score(F.col("x"))).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    none = preference.fit(x, labels.filter("false"))
    assert {round(r[0], 9) for r in x.select(none.score(F.col("x"))).collect()} == {0.3}
    assert empty.select(preference.features()).count() == 0


def test_slots(docs, empty):
    thin = docs.select("doc_id", "text", slots.record_size().alias("size"), slots.virtual_slot().alias("v"))
    m = slots.first_map(slots.slot_stats(thin, "v", "size"), 3)
    placed = slots.assign(thin, m, "v")
    rows = placed.select("shard", slots.place_in_shard(placed, "v", ["doc_id"]).alias("p"), "size").collect()
    for s in range(3):
        own = sorted(r.p for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert len(rows) == len(ROWS) and min(r["size"] for r in rows) == 8
    none = empty.select(slots.record_size().alias("size"), slots.virtual_slot().alias("v"))
    assert slots.first_map(slots.slot_stats(none, "v", "size"), 3).count() == slots.SLOTS


def test_mixing(docs, empty):
    got = mixing.with_copies(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["_fw_copies"] <= 3 for r in got)
    assert all(r["_fw_copies"] == 0 for r in got if r["_fw_size"] == 0)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.with_copies(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_html(spark):
    chain = html_crf.fit(60, 40)
    big = "<article>" + "<p>some longer text of a paragraph with words.</p>" * 3000 + "</article>"
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p>a &amp; b", "x"), (3, "u", "<p>a &amp; b", "x"), (4, "u", "<<<>< &#xD800; <p", "x"), (5, "u", big, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_crf.extract(pages, chain)
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == 6 and got[1] == got[2] == "" and got[5].count("\n") == 2999
    assert html_crf.extract(pages.filter("false"), chain).count() == 0


def test_pii(docs, empty, trees):
    assert ids(pii.detect(docs, trees)) == ALL
    assert pii.redact(docs, trees).columns == docs.columns
    assert pii.detect(empty, trees).count() == 0


def test_warc(spark, tmp_path):
    html = "<p>" + "x" * 200 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://b.org/x", html, "k"), (2, "http://a.org/y\nz", html, "k"), (2, "http://a.org/y\nz", html, "k"), (None, None, None, "k"), (3, "u", "short", "k"), (4, "u", "short", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, url_key string")
    _, index = warc.archive(pages, str(tmp_path / "w"))
    got = index.collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "response", None), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "response", None)]
    assert [r.url_key for r in sorted(got, key=lambda r: (r["range"], r.place))] == sorted(r.url_key for r in got)
    _, none = warc.archive(pages.filter("false"), str(tmp_path / "e"))
    assert none.count() == 0


def test_suffixes(docs, empty):
    got = suffix_dedup.remove_repeats(docs)
    assert ids(got) == ALL
    by = {r.doc_id: r for r in got.collect() if r.doc_id}
    assert by[1].n_bytes == 0 and bytes(by[4].kept) == b"" and bytes(by[2].kept) == b"" and len(by[5].spans) == 1
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_mixing_without_ids_agrees_on_any_partitioning(spark):
    """Null ids and rows with equal ids and different texts: hashed buckets, the same copies in every rerun."""
    rows = [(None, f"word{k} two three", "web") for k in range(3000)] + [(7, f"other{k} two three", "book") for k in range(900)] + [(None, "x y", None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(r.text for r in mixing.mix(df.repartition(n, F.rand(n))).collect()) for n in (3, 11))
    assert a == b and len(set(a)) > 1000
    size = mixing.with_copies(df)
    keyed = df.select(F.pmod(F.xxhash64("doc_id", F.lit("mix"), "text"), F.lit(mixing.BUCKETS)).alias("b")).distinct().count()
    assert keyed > 1500 and {r["_fw_target"] for r in size.collect()}


def test_a_missed_target_stops_the_job(spark):
    df = spark.createDataFrame([(k, "w " * (k % 9 + 1), f"s{k % 2}") for k in range(50)], "doc_id long, text string, source string")
    sizes = df.select(mixing.source_key().alias("_fw_source"), mixing.word_count(F.col("text")).alias("_fw_size")).groupBy("_fw_source", "_fw_size").agg(F.count("*").alias("n"))
    goal = mixing.targets(sizes)
    assert mixing.multipliers(sizes, goal).filter("lam IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="no multiplier found"):
        mixing.multipliers(sizes, goal, steps=1).collect()


def test_reserved_looking_columns_are_kept(spark, docs):
    odd = docs.selectExpr("*", "'a' AS _fw_size", "'b' AS _fw_key", "'c' AS _fw_copies", "'d' AS _fw_copy", "'e' AS c0")
    for out in (mixing.mix(odd), simhash.keep_one(odd)):
        assert out.columns == odd.columns
        assert {(r["_fw_size"], r["_fw_key"], r["_fw_copy"], r["c0"]) for r in out.collect()} == {("a", "b", "d", "e")}


def test_items_in_several_blocks(spark, docs):
    items = spark.createDataFrame([(k, f"item {k} " + GOOD * 2) for k in range(4)] + [(9, GOOD * 2)], "item_id long, text string")
    one = sorted(map(tuple, decontaminate.matches(docs, items).collect()))
    many = sorted(map(tuple, decontaminate.matches(docs, items, block_bytes=200).collect()))
    assert one == many and one
    assert decontaminate.clean(docs, items, block_bytes=200).count() == decontaminate.clean(docs, items).count()
