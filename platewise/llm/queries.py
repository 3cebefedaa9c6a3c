"""Registered queries of the training-data operators: name -> fn(spark, sf_dir).

Each applies its operator with production parameters to the whole table and
derives the contract's columns from the operator's output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import alignment, ann, bpe_codec, codebooks, langid, license_scan, minhash, packing, quality, topk, url_filter, warc, wordpiece
from platewise.llm.oracle import SQL  # noqa: F401 - read by the entry point
from platewise.llm.store import Scratch

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A tokenizer file's text."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@register
def op1_best_fit_packing(spark, sf_dir):
    """All documents in sequences of at most 1024 ids."""
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_pieces(digests)


@register
def op7_byte_bpe(spark, sf_dir):
    """Every text encoded and decoded again."""
    tokenizer = bpe_codec.rank_tokenizer(
        bpe_codec.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    ids = bpe_codec.encode(table(spark, sf_dir, "documents"), tokenizer).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), "ids")
    return bpe_codec.decode(ids, tokenizer).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op6_minhash_near_dedup(spark, sf_dir):
    """Every document's component of texts at 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op10_quality_rules(spark, sf_dir):
    """Every document's counts and verdict."""
    judged = quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("row.doc_id", *quality.COUNTS, "base_failed", "kept")


@register
def op4_language_id(spark, sf_dir):
    """Every document's language, learned from three quarters of the ids."""
    said = langid.identify(table(spark, sf_dir, "documents"), ["doc_id"])
    return said.select("row.doc_id", "held_out", "lang_pred", "score", "ambiguous")


@register
def op8_warc(spark, sf_dir):
    """Every page written to WARC archives and read back."""
    scratch = Scratch(spark, "warc")
    archives = f"{scratch.path}/archives"
    written = scratch.write(warc.write_archives(warc.mark_revisits(table(spark, sf_dir, "pages")), archives), "written")
    found = warc.read_archives(spark, archives, expected=written.count())
    return found.select(
        F.expr("cast(nullif(regexp_extract(record_id, '^<urn:page:(.*)>$', 1), 'None') as bigint)").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type",
        F.expr("cast(regexp_extract(refers_to, '^<urn:page:(.*)>$', 1) as bigint)").alias("refers_to"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@register
def op2_url_filter(spark, sf_dir):
    """Every page's url judged by rule or model."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@register
def op5_exact_top_k(spark, sf_dir):
    """The 20 best candidates of every twentieth vector."""
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("id") % 20 == 0, 20)


@register
def op3_token_counts(spark, sf_dir):
    """Greedy word-piece counts of every text."""
    starts, inside = wordpiece.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), starts, inside)


@register
def op9_license_scan(spark, sf_dir):
    """Every document's license, its place being source / language / doc_id."""
    place = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return license_scan.scan(table(spark, sf_dir, "documents").select(place.alias("path"), "text", "doc_id"), ["doc_id"])


@register
def op11_multi_index_hashing(spark, sf_dir):
    """The 10 nearest found of every hundredth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0, 10)


@register
def op12_vector_codes(spark, sf_dir):
    """Every usable vector's code and errors, and a digest of the codebooks."""
    coded, books = codebooks.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


@register
def op13_tokenizer_alignment(spark, sf_dir):
    """Every document's tokens by a byte-level and a word-piece vocabulary, aligned."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return alignment.compare(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), model)
