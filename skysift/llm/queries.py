"""The registered queries of the operators, and the SQL that some of them must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import bpe, chats, classlm, idfiles, langid, leaks, lines, multiset, periodic, phrases, quality, simhash, substrings
from skysift.llm.common import table
from skysift.plans.registered import Query


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words of repeated windows of 20 words."""
    kept = substrings.dedup_substrings(table(spark, folder, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE of every document, and back."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade of every document, probability of the best grade, and whether it is good enough to stay."""
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, quality.graded(table(spark, folder, "labels")), grades=3)
    scored = quality.score(docs.select("doc_id", "text"), model)
    keep = (F.col("tail_probability") >= quality.KEEP_FROM).alias("keep")
    return scored.select("doc_id", "expected_grade", "tail_probability", keep)


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its repeated and nearly repeated lines."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, n_lines="n_lines", n_removed="n_removed", grows=True)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and group of near copies of every document."""
    return simhash.component_rows(table(spark, folder, "documents"), shingle=4, max_bits=4)


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, folder, "documents")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model)
    held_out = langid.held_out(F.col("doc_id")).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", F.size("spans").alias("n_spans"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item that a document holds, exactly or with a few words edited."""
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_chat_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn of the conversations: linked, ordered and validated tool calls, and the messages beside them."""
    return chats.linked_turns(table(spark, folder, "conversations"))


def op9_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Class-based bigram score of every document, beside a smoothed unigram score."""
    return classlm.score(table(spark, folder, "documents"))


def op10_multiset_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Multiset fingerprints of every document and of its edited text."""
    return multiset.edited_rows(table(spark, folder, "documents"))


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as it stands in the files of token ids: where its ids start, how many they are, their checksum."""
    content = idfiles.read_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    back = idfiles.through_files(table(spark, folder, "documents"), content, end=2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words of every document, one in ten of them with a repeated end, and digests of what is left."""
    return periodic.digests(periodic.looped(table(spark, folder, "documents")))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 strongest phrases of two or three words of each language."""
    return phrases.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_chat_tools": op8_chat_tools,
    "op9_class_lm": op9_class_lm,
    "op10_multiset_fingerprint": op10_multiset_fingerprint,
    "op11_token_files": op11_token_files,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrases": op13_phrases,
}
SQL: dict[str, str] = {"op13_phrases": phrases.SQL}
