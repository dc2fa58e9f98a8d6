"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm import (centroid_lang, entropy_mix, packing, pii_spans, quartile_digest, secret_index,
                           simhash_anchor, spelling, suffix_dedup, token_alignment, token_counts, url_rules, va_file)
from sheetwise.llm.common import prepare, read_table
from sheetwise.llm.oracle import oracle_sql

__all__ = ["queries", "oracle_sql"]

# Production parameters.
TOKENIZER_FILE = "byte_bpe_50k.json"
RANKS_FILE = "byte_bpe_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"
SEQUENCE = 1024
SHINGLE = 3
MAX_BITS = 2
MIN_SUPPORT = 0.0005
MIN_CONFIDENCE = 0.0
MIN_LIFT = 1.5
REPEAT = 400
MIN_WORD = 7
MIN_COUNT = 2
FORM_RATIO = 10
URL_RULES = (
    url_rules.ListedRule("allow", "org/"),
    url_rules.ListedRule("block", "example.org/es/"),
    url_rules.ListedRule("block", "example.org/en/1"),
    url_rules.ListedRule("allow", "com/fr/"),
    url_rules.ListedRule("block", "com/de/"),
)


def tokenizer_paths() -> tuple[str, str]:
    """Where the public vocabulary files are (a package on every machine)."""
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER_FILE)), str(public_tokenizers.path(RANKS_FILE))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged; a page's number in its path is the document that has the label."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels")
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/[^/?#]*/([0-9]{1,18})", 1)
    labelled = (pages.select("url", number.try_cast("long").alias("doc_id")).join(labels, "doc_id")
                .select("url", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked")))
    mined = url_rules.mine(labelled, MIN_SUPPORT, MIN_CONFIDENCE, min_lift=MIN_LIFT)
    return url_rules.judge(pages, mined, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(read_table(spark, sf_dir, "documents"), *tokenizer_paths())
    return token_counts.length_histogram(lengths)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_anchor.near_duplicates(read_table(spark, sf_dir, "documents"), SHINGLE, MAX_BITS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), *tokenizer_paths(), max_len=SEQUENCE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024)


def _span_texts(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _base_digest(spans: Column, kinds: list[str]) -> Column:
    base = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.sha2(F.array_join(_span_texts(base), ",").cast("binary"), 256).alias("base_sha256")


def _span_columns(spans: Column, kinds: list[str]) -> list[Column]:
    return [*[_count(spans, k) for k in kinds], _base_digest(spans, kinds), F.array_join(_span_texts(spans), ",").alias("spans")]


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", secret_index.secret_spans(F.col("text")).alias("spans"))
    return docs.select("doc_id", *_span_columns(F.col("spans"), [r.kind for r in secret_index.BASE_RULES]))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile_digest.with_next(read_table(spark, sf_dir, "documents"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = centroid_lang.fit(docs.filter(~held_out(F.col("doc_id"))))
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), centroid_lang.predicted(F.col("text"), model).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *_span_columns(F.col("spans"), [k.name for k in pii_spans.KINDS if k.base]))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(read_table(spark, sf_dir, "documents"))


def damaged(doc_id: Column, run: Column) -> Column:
    """A run without one code point, if 31 divides the checksum of its document and itself."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(read_table(spark, sf_dir, "documents"), MIN_WORD)
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word"))
    return spelling.group(spelling.counted(words, MIN_WORD, MIN_COUNT), FORM_RATIO)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.alignment(read_table(spark, sf_dir, "documents"), *tokenizer_paths(), str(public_tokenizers.path(PIECE_FILE)))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(read_table(spark, sf_dir, "documents"), REPEAT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)
        return run

    return {f.__name__: ready(f) for f in (op1_url_filter, op2_token_counts, op3_simhash, op4_packing, op5_topk, op6_secrets,
                                           op7_fingerprint, op8_language, op9_pii, op10_mix,
                                           op11_spelling, op12_alignment, op13_suffix_dedup)}

