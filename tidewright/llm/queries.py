"""One query per operator over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import (
    chat, decontaminate, divergence, embedding_join, html_wrappers, jaccard_join, language_id, license_scan, outliers, packing, quality, secret_scan, spelling,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against every benchmark item."""
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


@query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by wrappers inferred from all pages of its host."""
    return html_wrappers.main_text(table(spark, sf_dir, "pages"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return language_id.identify(docs, docs.where(~held_out), F.coalesce(held_out, F.lit(False)))


@query("op4_secret_scan", secret_scan.oracle())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with the ownership of their values over all documents."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def license_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, thousands and hundreds of the id; short ones that name a licence are licence files."""
    a, b = (F.floor(F.col("doc_id") / n) for n in (1000, 100))
    high, low = F.concat_ws("/", "source", a.cast("string")), F.concat_ws("/", "source", a.cast("string"), (b % 10).cast("string"))
    names = (F.length("text") < 1000) & F.col("text").contains("icense")
    at = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, high).otherwise(low)
    name = F.col("doc_id").cast("string")
    path = F.when(names, F.concat(at, F.lit("/LICENSE-"), name)).otherwise(F.concat(low, F.lit("/"), name))
    return docs.select("doc_id", "text", path.alias("path"))


LICENSE_FILES = """SELECT doc_id, text, CASE WHEN length(text) < 1000 AND contains(text, 'icense') THEN
    CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source || '/' || (doc_id // 1000) ELSE source || '/' || (doc_id // 1000) || '/' || (doc_id // 100 % 10) END
    || '/LICENSE-' || doc_id ELSE source || '/' || (doc_id // 1000) || '/' || (doc_id // 100 % 10) || '/' || doc_id END AS path FROM documents"""


@query("op5_license_scan", license_scan.oracle(LICENSE_FILES))
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, laid out as a tree of files."""
    return license_scan.scan(license_files(table(spark, sf_dir, "documents")))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 4-word shingles, similarity 0.85."""
    return jaccard_join.classes(table(spark, sf_dir, "documents"), 4, 85)


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


@query("op9_chat_formatting")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, read back from their formatted text."""
    odd = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.round_trip(told.unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")))


@query("op10_embedding_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all embeddings at cosine 0.95."""
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of at least seven letters; one in 31 words of a document lost a letter."""
    found = spelling.variants(table(spark, sf_dir, "documents"), shortest=7, least=2, times=10, every=31)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_source_divergence", divergence.oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its 50 terms most overused."""
    return divergence.audit(table(spark, sf_dir, "documents"), least=30, top=50)


@query("op13_quality_rules")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed limits and robust outliers per language and source, for every document."""
    return outliers.judge(table(spark, sf_dir, "documents"))
