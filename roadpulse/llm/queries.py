"""The operators applied to their whole tables, with production parameters and plain result columns."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import decontaminate, html, kneser_ney, languages, negatives, phrases, pieces, quality, sharding, simhash, suffixes, toxicity, urls, warc
from roadpulse.llm.shared import table, text_or_empty
from roadpulse.session import shared_dir, ship_package


def op1_histogram_shards(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.crc32(text_or_empty()).alias("text_crc32"))
    return sharding.histogram_shards(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_winnowing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_hits(docs, table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op3_quality_ledger(spark, sf):
    # The share of repeated lines decides for every text, however few they are.
    rows = quality.ledger(table(spark, sf, "documents").select("doc_id", "text"), least_dup_lines=1)
    judged = quality.apply_policy(rows, "v2")
    return judged.select(
        "doc_id",
        *quality.MEASURES,
        "failed_bits",
        (~quality.passes("base")).alias("base_failed"),
        "kept",
    )


def op4_simhash_pigeonring(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op5_splittable_warc(spark, sf):
    folder = shared_dir(spark, "warc")
    written = warc.write_archives(warc.plan_records(table(spark, sf, "pages")), folder)
    written.agg(F.sum("n_records")).collect()
    return warc.read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_nearest_url_differencing(spark, sf):
    found = html.main_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_kneser_ney_toxicity(spark, sf):
    docs = toxicity.with_digest(table(spark, sf, "documents").select("doc_id", "text"), "a", "b")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    scored = kneser_ney.score(toxicity.score(docs, model), kneser_ney.train(model), docs)
    return scored.select(
        "doc_id", (toxicity.fold() == toxicity.HELD_OUT).alias("held_out"), "score", "predicted", "kn_score", "kn_predicted"
    )


def piece_model() -> str:
    """The place of the public vocabulary file on the machine that asks."""
    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece_backtracking(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = pieces.encode_and_decode(docs, piece_model())
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        pieces.ids_digest().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bucket_pointer_refinement(spark, sf):
    cut = suffixes.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_url_vocabulary(spark, sf):
    judged = urls.url_filter(table(spark, sf, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "n_strict", "n_soft", "verdict")


def op11_hyperdimensional_language(spark, sf):
    docs = table(spark, sf, "documents")
    profiles = languages.train(docs.select("doc_id", "text", "lang"))
    return languages.identify(docs.select("doc_id", "text"), profiles).select(
        "doc_id", (languages.fold() == languages.HELD_OUT).alias("held_out"), "lang_pred", "score"
    )


def op12_misra_gries_phrases(spark, sf):
    return phrases.collocations(table(spark, sf, "documents").select("text", "lang"))


def op13_bond_hard_negatives(spark, sf):
    return negatives.hard_negatives(table(spark, sf, "embeddings"))


QUERIES = {name: make for name, make in list(globals().items()) if name.startswith("op")}


def with_package(make):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return make(spark, sf_dir)

    return query


def all_queries():
    return {name: with_package(make) for name, make in QUERIES.items()}
