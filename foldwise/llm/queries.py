"""One query per operator over the supplied tables, and the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.llm import (
    decontaminate, html_crf, mixing, nested_secrets, pii, preference, quality_rules, simhash, slots, suffix_dedup, turn_repair, warc, whitening,
)
from foldwise.llm.checks import ORACLES
from foldwise.llm.text import table, whole
from foldwise.session import materialize, ship_package

QUERIES: dict = {}


def query(fn):
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op6_quality_rules(spark, sf):
    """Counts and verdict of every document."""
    m = "quality.measures."
    base = (F.col(m + "n_words") < 20) | (100 * F.col(m + "n_repeat_words") > 30 * F.col(m + "n_words"))
    return quality_rules.judge(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", *[m + c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"), (~base & F.col("quality.kept")).alias("kept"),
    )


@query
def op5_slot_shards(spark, sf):
    """All documents in 24 shards of nearly equal bytes, through the slot table."""
    thin = materialize(table(spark, sf, "documents").select(
        "doc_id", slots.record_size().alias("size"), F.crc32(whole("text")).alias("text_crc32"), slots.virtual_slot().alias("v_slot"),
    ))
    slot_map = slots.first_map(slots.slot_stats(thin, "v_slot", "size"), 24)
    placed = slots.assign(thin, slot_map, "v_slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        slots.place_in_shard(placed, "v_slot", ["doc_id", "text_crc32", "size"]).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "v_slot",
    )


@query
def op7_entropy_mix(spark, sf):
    """Words that the mixture takes of every document."""
    thin = materialize(table(spark, sf, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    return mixing.with_copies(thin, text="text_hash", size="size").select(
        "doc_id", "size", F.col("_fw_source_size").alias("source_size"), F.col("_fw_target").alias("target"),
        (F.col("_fw_copies") * F.col("size")).alias("taken"),
    )


@query
def op2_simhash(spark, sf):
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_decontaminate(spark, sf):
    """Every document and benchmark item whose passage it holds, with the edit distance."""
    return decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op4_preference_quality(spark, sf):
    """Score and prediction of every document."""
    featured = materialize(table(spark, sf, "documents").select("doc_id", preference.features().alias("x")))
    model = preference.fit(featured, table(spark, sf, "labels"))
    return featured.select("doc_id", preference.held_out().alias("held_out"), model.score(F.col("x")).alias("score")).withColumn(
        "predicted", (F.col("score") >= preference.CUT).cast("int")
    )


@query
def op10_warc_index(spark, sf):
    """All pages written as WARC, read back and merged into one capture history."""
    _, merged = warc.archive(table(spark, sf, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "offset", "length")


@query
def op1_suffix_dedup(spark, sf):
    """Bytes of every document that lie in repeated strings of 400 bytes, and the digest of the rest."""
    left = suffix_dedup.remove_repeats(table(spark, sf, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return left.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op9_pii_spans(spark, sf):
    """Counts and spans of personal data in every document."""
    seen = pii.detect(table(spark, sf, "documents").select("doc_id", "text"), pii.fit(spark))
    return seen.select(
        "doc_id", *[pii.count_kind(F.col("pii.base"), k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.span_list(F.col("pii.base")), 256).alias("base_sha256"),
        pii.span_list(F.sort_array(F.concat("pii.base", "pii.more"))).alias("spans"),
    )


@query
def op8_html_crf(spark, sf):
    """Main text of every page."""
    text = html_crf.extract(table(spark, sf, "pages"), html_crf.fit())
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_turn_repair(spark, sf):
    """Faults, cheapest edits and digest of the repaired turns of every damaged conversation."""
    rows = turn_repair.damaged(table(spark, sf, "conversations"))
    found = materialize(turn_repair.verdicts(rows, present="here"))
    told = found.join(turn_repair.digests(rows, found, present="here"), "_fw_key")
    return told.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@query
def op12_secret_layers(spark, sf):
    """Counts and spans of secrets in every document, those behind nested encodings included."""
    seen = nested_secrets.scan(table(spark, sf, "documents").select("doc_id", "text")).drop("text")
    base = nested_secrets.base_finds(F.col("secrets"))
    return seen.select(
        "doc_id", *[nested_secrets.count_kind(base, k).alias(f"n_{k}") for k in nested_secrets.BASE],
        F.sha2(nested_secrets.span_list(base), 256).alias("base_sha256"), nested_secrets.span_list(F.col("secrets")).alias("spans"),
        (F.size("secrets") - F.size(base)).cast("long").alias("n_layered"),
    )


@query
def op13_embedding_whitening(spark, sf):
    """Up to 16 whitened components of every usable vector."""
    rows, model, error = whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    share = model.share() if model else []
    n = F.lit(model.n if model else 0).cast("long")
    return rows.select("vec_id", "whitened_deviation", F.posexplode("whitened").alias("k", "w")).select(
        "vec_id", (F.col("k") + 1).alias("component"), n.alias("n"), F.col("whitened_deviation").try_cast("long").alias("deviation"), F.col("w").alias("whitened"),
        F.element_at(F.array(*[F.lit(s) for s in share]).cast("array<double>"), F.col("k") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), F.col("whitened_deviation").alias("deviation_exact"),
    )
