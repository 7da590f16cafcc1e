"""The registered queries of this subpackage: each applies an operator, with the
parameters of production, to its whole table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import oracles
from foldwise.llm.common import table, workers_ready
from foldwise.llm.secret_forest import Forest
from foldwise.llm.secret_labels import CONTEXT, label

TOKENIZER, DICTIONARY, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Of the installed public tokenizer files."""
    import public_tokenizers
    return public_tokenizers.path(name)


# ------------------------------------------------------------------ secrets

#: fixed values: formats that the tests look for, of those that ``label`` knows
REVIEWED = (re.compile(r"AKIA[0-9A-Z]{16}"), re.compile(r"[0-9a-fA-F]{40}"))
REVIEWED_VALUE, REVIEWED_NAME = re.compile(r"(?=\S*\d)[0-9A-Za-z]{12,}"), re.compile(r"(?i)(password|passwd|secret)\W{1,4}$")


def labelled_findings(docs: DataFrame) -> DataFrame:
    """A stand-in for a reviewed table of findings (text, start, end, path, secret): candidates
    of all documents with the text around them, those that ``label`` can tell."""
    workers_ready(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        from foldwise.llm.secret_forest import candidates
        for batch in batches:
            rows = []
            for text, path in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                for s, e in candidates(text) if text else ():
                    secret = label(text, s, e, path)
                    if secret is not None:
                        at = max(0, s - CONTEXT)
                        rows.append((text[at:e + CONTEXT], s - at, e - at, path, secret))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["text", "start", "end", "path", "secret"])

    return docs.select("text", "source").mapInArrow(run, "text string, start long, end long, path string, secret int")


def secret_model(docs: DataFrame) -> Forest:
    from foldwise.llm.secret_forest import fit_forest
    return fit_forest(labelled_findings(docs), tokenizer_path(DICTIONARY))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in ``documents``, by a forest fitted on labelled findings."""
    from foldwise.llm.secret_forest import scan
    docs = table(spark, sf_dir, "documents")
    return scan(docs, secret_model(docs), tokenizer_path(DICTIONARY), path_col="source")


# ------------------------------------------------------------------ search

NEIGHBOURS, EVERY = 5, 50


def op2_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every 50th of ``embeddings``, by integer inner product."""
    from foldwise.llm.topk_blocks import top_k
    return top_k(table(spark, sf_dir, "embeddings"), NEIGHBOURS, EVERY)


# ------------------------------------------------------------------ documents

def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the quality rules for every document."""
    from foldwise.llm.quality_rules import quality
    return quality(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document (three-word shingles,
    at most two differing bits)."""
    from foldwise.llm.simhash_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document (weights 5, 2, 1 in turn, 150 % of all
    words, at most two copies)."""
    from foldwise.llm.pareto_mix import mix_report
    return mix_report(table(spark, sf_dir, "documents"))


def op6_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the Arrow token stream of ``documents``,
    which is written (end id 0) and read back."""
    from foldwise.llm.token_stream import token_stream_digest
    return token_stream_digest(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of ``documents`` packed into sequences of at most 2,048 tokens (end id 1)."""
    from foldwise.llm.vector_packing import pack_texts
    return pack_texts(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


# ------------------------------------------------------------------ languages, licences, pages

def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned outside the held-out fifth."""
    from foldwise.llm.language_id import fit, predict
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit(docs.where(fold != 0))
    fold_of = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return predict(docs, model).select("doc_id", F.coalesce(fold_of == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of ``documents`` that matches a licence template."""
    from foldwise.llm.license_scan import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents"))


#: fixed values: host, path, verdict
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page, by the rules or by what the link graph says of its host."""
    from foldwise.llm.url_trust import judge
    return judge(table(spark, sf_dir, "pages"), URL_RULES)


# ------------------------------------------------------------------ language model, tokenizers, whitening

def op11_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by a modified Kneser-Ney model that learns outside one fifth."""
    from foldwise.llm.kneser_ney import fit, fold_of, score
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(F.coalesce(fold_of() != 1, F.lit(True))))
    return score(docs, model).withColumn("held_out", F.coalesce(fold_of() == 1, F.lit(False))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's tokens by two tokenizers, with corpus-wide counts of linked ids."""
    from foldwise.llm.token_links import link_report
    return link_report(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector of ``embeddings``."""
    from foldwise.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_topk_blocks, op3_quality_rules, op4_simhash_dedup, op5_pareto_mix, op6_token_stream,
    op7_vector_packing, op8_language_id, op9_license_scan, op10_url_trust, op11_kneser_ney, op12_token_links,
    op13_whitening)}

ORACLES = {"op2_topk_blocks": oracles.top_k(NEIGHBOURS, EVERY), "op3_quality_rules": oracles.quality(),
           "op5_pareto_mix": oracles.pareto(), "op10_url_trust": oracles.url_filter(URL_RULES)}
