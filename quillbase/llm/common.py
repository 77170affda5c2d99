"""What the operators of this subpackage share: per-document Arrow maps, folds, shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import drop_stored, remove, shared_dir, stored

__all__ = ["bucketed", "drop_stored", "fold", "per_document", "remove", "sampled", "shared_dir", "stored", "table"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, by a hash of the key; equal keys stay together but for the last.

    The hash first leaves about that many of all rows, so that the final sort is of few rows, however many there are.
    """
    n = df.count()
    share = min(1.0, 1.5 * most / max(1, n))
    code = F.xxhash64(key)
    kept = df if share == 1.0 else df.where(code <= F.lit(int(share * 2**64) - 2**63))
    return kept.orderBy(code, key).limit(most)


def per_document(
    df: DataFrame,
    make: Callable[[], Callable[[list[str | None]], Sequence[list]]],
    outputs: str,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    per_call: int = 256,
) -> DataFrame:
    """The columns `keep` and, for each row, the columns `outputs` (a DDL) computed from its text.

    make() is called once in each task and returns a function from a list of texts (None for null) to one list
    for each output column. Rows stay where they are: no shuffle, and no more than per_call texts at a time.
    Columns not in `keep` are dropped; a kept column with the name of an output gives way to the output.
    """
    out = T._parse_datatype_string(outputs) if isinstance(outputs, str) else outputs
    names = set(out.names)
    kept = [c for c in keep if c not in names]
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text__"))
    schema = T.StructType([src.schema[c] for c in kept] + list(out.fields))
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for at in range(0, batch.num_rows, per_call):
                part = batch.slice(at, per_call)
                made = call(part.column(len(kept)).to_pylist())
                arrays = [part.column(i) for i in range(len(kept))] + [pa.array(v, t) for v, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return src.mapInArrow(run, schema)


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by a key, so that joins and groups by it don't shuffle it."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)
