"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from abode.llm import (chat_format, imatch, mixing, ngram_join, piece_sampling, quality_model, quality_rules, secret_scan, suffix_dedup,
                       token_counts, turn_repair, url_filter, vector_codes)
from abode.llm.registry import documents, register, table
from abode.session import materialize


@register("op4_quality_rules", quality_rules.oracle())
def op4(spark, sf_dir):
    out = quality_rules.apply_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op3_mix_sources", mixing.oracle())
def op3(spark, sf_dir):
    sized = documents(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.mix(materialize(sized, "mix-sizes"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


MAX_TOKENS = 512


@register("op9_token_counts")
def op9(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = token_counts.count_tokens(docs, token_counts.tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


@register("op2_chat_format", chat_format.oracle())
def op2(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit(chat_format.PLANTED).alias("text"))
    return chat_format.read_back(chat_format.format_chats(chats.unionByName(planted)))


@register("op10_secret_scan")
def op10(spark, sf_dir):
    found = secret_scan.find_secrets(documents(spark, sf_dir).select("doc_id", "text")).drop("text")

    def number(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select("doc_id", *[number(k) for k in secret_scan.BASE_KINDS],
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


@register("op8_ngram_join", ngram_join.oracle())
def op8(spark, sf_dir):
    return ngram_join.components(documents(spark, sf_dir).select("doc_id", "text"))


@register("op6_imatch")
def op6(spark, sf_dir):
    return imatch.compare_with_next(documents(spark, sf_dir).select("doc_id", "text"))


GOOD_FROM = 0.7


@register("op1_quality_model")
def op1(spark, sf_dir):
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    out = quality_model.score(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


@register("op5_piece_sampling")
def op5(spark, sf_dir):
    path = token_counts.tokenizer_path("piece_bpe_32k.model")
    pieces = piece_sampling.encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    out = piece_sampling.decode(pieces, path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("pieces_hash"),
                      F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


@register("op7_suffix_dedup", suffix_dedup.oracle())
def op7(spark, sf_dir):
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@register("op11_url_filter", url_filter.oracle())
def op11(spark, sf_dir):
    out = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


@register("op12_turn_repair", turn_repair.oracle())
def op12(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = turn_repair.damaged(chats)
    plans = materialize(turn_repair.plan_repairs(damaged), "turn-plans")
    said = turn_repair.digests(turn_repair.repaired_turns(damaged, plans))
    same = [F.col("conv_id").eqNullSafe(F.col(c)) for c in ("_plan", "_said")]
    out = (chats.select("conv_id").distinct()
           .join(plans.withColumnRenamed("conv_id", "_plan"), same[0], "left")
           .join(said.withColumnRenamed("conv_id", "_said"), same[1], "left"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@register("op13_vector_codes", vector_codes.oracle())
def op13(spark, sf_dir):
    out, books = vector_codes.encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
                      F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))
