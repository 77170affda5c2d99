"""Documents to token ids, in stages; each is written as Parquet and read again as the next one's documents.

1. toxicity: documents predicted toxic go.
2. near-duplicates by SimHash and exact comparison: texts link at a similarity of 0.8 of their five-word shingles; of each
   group one row stays, that of the smallest id (of rows with that id, the one with the smallest hash; rows without an
   id come last). Rows of one id in different groups are different documents.
3. benchmark decontamination: documents that hold a window of a benchmark item go.
4. personal data: spans give way to the name of their kind; n_chars follows.
5. byte-level BPE: ids of each text, with the digests of ids and of the decoded bytes.

All but the last return the columns of documents, whatever they are. Documents that no stage objects to come through
unchanged. A null text is never rejected and has no
ids; texts without words, null ones too, are near-duplicates of each other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.llm import byte_bpe, decontaminate, pii, simhash, toxicity
from quillbase.llm.common import remove, shared_dir, table


def _apply(docs: DataFrame, operator, then) -> DataFrame:
    """The columns of docs for the rows that operator and then leave; their names can't clash with the operator's.

    operator(df, text column, all columns) adds its columns; then(df, column) filters or changes, where column(name) is
    the coded name of a column of docs.
    """
    coded = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    made = operator(docs.toDF(*coded.values()), coded["text"], tuple(coded.values()))
    return then(made, coded).select(*[F.col(v).alias(c) for c, v in coded.items()])


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _apply(docs, lambda d, text, keep: toxicity.with_toxicity(d, model, text, keep), lambda d, _: d.where("predicted = 0"))


def _row_code(docs: DataFrame) -> Column:
    """128 bits of all columns: rows with the same code are the same."""
    hashed = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema]
    return F.struct(F.xxhash64(*hashed).alias("a"), F.xxhash64(F.lit(1), *hashed).alias("b"))


def duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def first(d: DataFrame, coded: dict[str, str]) -> DataFrame:
        # ids can repeat or be null, so a row is known by its code
        key = coded["doc_id"]
        groups = simhash.similar_groups(d, key, coded["text"], ("code",))
        kept = groups.groupBy("root").agg(F.min(F.struct(F.isnull(key).alias("last"), F.col(key).alias("id"), F.col("code").alias("row"))).alias("of")).select("of.row")
        return d.join(kept, F.col("code") == F.col("row"), "left_semi").dropDuplicates(["code"])

    return _apply(docs, lambda d, text, keep: d.withColumn("code", _row_code(d)), first)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return _apply(docs, lambda d, text, keep: decontaminate.with_hits(d, items, text, keep), lambda d, _: d.where("n_hit = 0"))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tagger = pii.train(docs)

    def change(d: DataFrame, coded: dict[str, str]) -> DataFrame:
        text = coded["text"]
        d = d.withColumn(text, F.when(F.col(text).isNotNull(), F.col("redacted")))
        if "n_chars" in coded:
            d = d.withColumn(coded["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
        return d

    return _apply(docs, lambda d, text, keep: pii.with_spans(d, tagger, text, keep), change)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.with_token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=True)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash", duplicates_out),
    ("decontaminate", benchmark_out),
    ("pii", personal_data_out),
    ("byte_bpe", token_ids),
]

#: SQL can express neither the learnt stages nor the hashes; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if place:  # what the stage read isn't needed any more
            remove(spark, before)
        before = path
    return docs
