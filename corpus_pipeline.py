"""The corpus pipeline: language ID, near-duplicate removal, PII redaction, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs; all but the last return the columns of documents. A stage sets the session's Arrow batches to few rows, unless it has a size of its own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, langid, mixing, neardup, pii
from cairn.llm.queries import held_out, table, vocabulary
from cairn.llm.shared import carried, small_batches, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text that is mostly in no language: under this evidence, over its letters, for the likeliest language of each word.
LEAST_LANGUAGE = 0.4
FRACTION = 0.5
#: Words in a worker's table of BPE, about 250 bytes each: fewer than bpe.TABLE_WORDS, since the executor's heap has grown in the stages before.
TABLE_WORDS = 200_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with evidence under LEAST_LANGUAGE for any language, go; those that switch between languages stay. lang becomes the language of most letters."""
    small_batches(spark)
    model = langid.train(langid.training_samples(docs.filter(~held_out())))

    def run(text):
        found = langid.judged(model, text)
        return [pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, _, x in found], pa.float64())]

    out = carried(docs.select(*COLUMNS), run, {"lang_pred": "string", "lang_evidence": "double"})
    kept = out.filter((F.col("lang_pred") != "und") & (F.col("lang_evidence") >= LEAST_LANGUAGE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays, the one of smallest doc_id; repeated rows of it count once, and different texts under its doc_id all stay. Rows without doc_id stay, as in all stages."""
    small_batches(spark)
    found = neardup.near_duplicates(docs, words=5, percent=80)
    kept = docs.select(*COLUMNS).join(found.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    kept = kept.withColumn("_text", F.sha2("text", 256)).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return kept.unionByName(docs.select(*COLUMNS).filter("doc_id IS NULL")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data whose score reaches pii.LEAST are replaced by their kind in brackets; n_chars follows. A null text stays null."""
    small_batches(spark)

    def run(text):
        return [pa.array([pii.redact(t, pii.find(t), pii.LEAST) if t else t for t in text.to_pylist()], pa.string())]

    out = carried(docs.select(*COLUMNS), run, {"text": "string"})
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target shares of sources, languages and topics, those without doc_id too, by a hash of their text; FRACTION of the tokens are expected to stay. Nulls in source or lang are a name of their own."""
    small_batches(spark)
    drawn = mixing.mix(docs, fraction=FRACTION, carry=COLUMNS).filter("sampled")
    return drawn.select(*(F.col(mixing.CARRIED + c).alias(c) for c in COLUMNS))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids, and whether they decode to the text."""
    small_batches(spark)
    path = vocabulary("byte_bpe_50k.json")

    def run(text):
        t = bpe.tokenizer(path, TABLE_WORDS)
        texts = [x or "" for x in text.to_pylist()]
        flat, sizes = t.encode_batch(texts)
        at = [0, *sizes.cumsum().tolist()]
        same = [t.decode(flat[a:b].tolist()) == x for a, b, x in zip(at[:-1], at[1:], texts, strict=True)]
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32())), pa.array(same)]

    out = carried(docs.select("doc_id", "text"), run, {"ids": "array<int>", "round_trip": "boolean"})
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing_weights), ("bpe_tokens", bpe_tokens)]
#: The language model, the sampling hash and BPE have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
