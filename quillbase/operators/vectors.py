"""Vector search by inverted lists: centres fitted on a bounded sample, every row in the list of its nearest centre, exact scores.

An index is a table partitioned by list, so that a query's probes are partition filters and other lists aren't opened. Lists that
hold a large part of all rows are files that many tasks read; no list is collected. With all lists probed, a search is the full scan.
Rows without a vector, or with one of zeros, are never found. Vectors are of one length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import nearest
from .versions import Versions

#: The centres are fitted on at most so many rows, in so many rounds.
MAX_SAMPLE, ROUNDS = 20_000, 12
#: Rows and queries that meet in one group, on average, and queries multiplied at once.
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 4096, 20_000, 256
#: A product of matrices differs from the sum in order by less than this; scores are rounded to 6 places after it.
SLACK = 2e-6


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def centres_of(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centres of spherical k-means; a centre without rows takes the row that is furthest from its own."""
    rows = _unit(sample.astype(np.float64))
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(lists, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        near = rows @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = rows[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def _read(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column as rows, and which have one of the right length that isn't zero."""
    rows = np.zeros((len(column), size))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == size and None not in v:
            rows[i] = v
    return rows, np.abs(rows).sum(axis=1) > 0


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().astype(np.float64).reshape(-1, size)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the places, as search.cosine does."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _block(size: int, limit: int, names: list[str]):
    """Of a block of rows (key, vector) those that can be among the first `limit` of each query (id, vector) of another, with exact scores.

    A matrix product finds what is not surely behind; of equal scores the first `limit` keys stay.
    """

    def call(rows: pa.Table, asked: pa.Table) -> pa.Table:
        kept_q, kept_r, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if rows.num_rows and asked.num_rows:
            r, q = _matrix(rows.column("vector"), size), _matrix(asked.column("vector"), size)
            rr, qq = np.sqrt(_dot(r, r)), np.sqrt(_dot(q, q))
            place = np.empty(len(r), np.int64)
            place[pc.sort_indices(rows.column("key")).to_numpy()] = np.arange(len(r))
            k = min(limit, len(r))
            for at in range(0, len(q), AT_ONCE):
                near = (q[at : at + AT_ONCE] / qq[at : at + AT_ONCE, None]) @ (r / rr[:, None]).T
                least = np.partition(near, len(r) - k, axis=1)[:, len(r) - k]
                qi, ri = np.nonzero((near >= least[:, None] - SLACK) | np.isnan(near))
                qi += at
                score = _dot(r[ri], q[qi]) / (rr[ri] * qq[qi])
                order = np.lexsort((place[ri], -score, qi))
                qi, ri, score = qi[order], ri[order], score[order]
                new = np.ones(len(qi), bool)
                new[1:] = (qi[1:] != qi[:-1]) | (score[1:] != score[:-1])
                n = np.arange(len(qi))
                first = n - np.maximum.accumulate(np.where(new, n, 0)) < limit
                kept_q.append(qi[first])
                kept_r.append(ri[first])
                scores.append(score[first])
        ids, keys = asked.column("id").take(pa.array(np.concatenate(kept_q))), rows.column("key").take(pa.array(np.concatenate(kept_r)))
        return pa.Table.from_arrays([ids, keys, pa.array(np.concatenate(scores))], names=names)

    return call


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.key, self.vector = spark, key, vector
        self.store = Versions(spark, root)

    def build(self, rows: DataFrame, lists: int | None = None) -> int:
        """Indexes every row; lists: by default the square root of the rows. The version.

        The sample are the rows whose keys hash lowest, at most MAX_SAMPLE; the centres are part of the manifest.
        """
        usable = rows.where(F.col(self.vector).isNotNull() & F.exists(self.vector, lambda x: x != 0))
        n = usable.count()
        lists = lists or max(1, min(4096, round(n**0.5)))
        if not n:
            return self.store.publish({"rows": rows.select(F.col(self.key).alias("key"), F.col(self.vector).alias("vector"), F.lit(0).alias("list")).limit(0)}, centres=[])
        code = F.xxhash64(F.col(self.key))
        share = min(1.0, 1.5 * MAX_SAMPLE / n)
        some = usable if share == 1.0 else usable.where(code <= F.lit(int(share * 2**64) - 2**63))
        sample = [r[0] for r in some.orderBy(code, self.key).limit(MAX_SAMPLE).select(self.vector).collect()]  # bounded by MAX_SAMPLE
        centres = centres_of(np.array(sample, np.float64), lists)
        size = centres.shape[1]

        def assign(batches):
            for batch in batches:
                vectors, there = _read(batch.column("vector"), size)
                own = (vectors @ centres.T).argmax(axis=1).astype(np.int32)
                kept = pa.array(there)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=["key", "vector", "list"]).filter(kept)

        src = rows.select(F.col(self.key).alias("key"), F.col(self.vector).alias("vector"))
        made = src.mapInArrow(assign, f"key {src.schema['key'].dataType.simpleString()}, vector {src.schema['vector'].dataType.simpleString()}, list int")
        folder = self.store.new_folder("vectors")
        # a large list is dealt to several tasks by its keys
        made.repartition(F.col("list"), F.pmod(F.xxhash64("key"), F.lit(max(1, n // (lists * 50_000))))).write.option("compression", "zstd").partitionBy("list").parquet(f"{self.store.root}/{folder}")
        return self.store.commit({"rows": folder, "centres": centres.tolist()}, self.store.latest())

    def _open(self) -> tuple[DataFrame, np.ndarray]:
        state = self.store.manifest()
        if not state.get("centres"):
            return self.store.read(state["tables"]["rows"]), np.zeros((0, 0))
        return self.store.read(state["rows"]), np.array(state["centres"])

    def search(self, query: Sequence[float], limit: int = 10, probes: int | None = None) -> DataFrame:
        """The nearest rows by cosine, exactly scored, from the `probes` lists whose centres are nearest (all if not given): key, score."""
        rows, centres = self._open()
        if len(centres):
            order = np.argsort(-(centres @ np.asarray(query, np.float64)), kind="stable")[:probes]
            if probes is not None:
                rows = rows.where(F.col("list").isin(order.tolist()))
        return nearest(rows, query, limit, "key", "vector").withColumnRenamed("key", self.key)

    def search_many(self, queries: DataFrame, limit: int = 10, probes: int = 8, id_col: str = "query_id", vector: str = "query") -> DataFrame:
        """The nearest rows of each query (id_col, vector): id_col, rank, key, score.

        Rows are dealt into blocks of about BLOCK_ROWS within their list (within all, if every list is probed). Queries meet the blocks that
        they probe, by matrix products; a block keeps its first `limit` (at most 1000) of a query, and equal ones.
        """
        if not 1 <= limit <= 1000:
            raise ValueError("limit: 1 to 1000")
        rows, centres = self._open()
        size = centres.shape[1]
        src = queries.select(F.col(id_col).alias("id"), F.col(vector).alias("vector"))
        types = {c: df.schema[c].dataType.simpleString() for df, c in ((src, "id"), (rows, "key"))}
        if not size:
            return self.spark.createDataFrame([], f"`{id_col}` {types['id']}, rank int, `{self.key}` {types['key']}, score double")
        every = probes >= len(centres)

        def probe(batches):
            for batch in batches:
                vectors, there = _read(batch.column("vector"), size)
                order = np.zeros((len(vectors), 1), np.int64) if every else np.argsort(-(vectors @ centres.T), axis=1, kind="stable")[:, :probes]
                at = np.flatnonzero(there)
                taken = batch.take(pa.array(np.repeat(at, order.shape[1])))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(order[at].ravel().astype(np.int32))], names=["id", "vector", "list"])

        asked = src.mapInArrow(probe, f"id {types['id']}, vector {src.schema['vector'].dataType.simpleString()}, list int")
        rows = rows.select("key", "vector", F.lit(0).alias("list") if every else F.col("list").cast("int").alias("list"))
        # a row for each list, at most 4096
        parts = F.broadcast(rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts")))
        blocks = -(-max(1, queries.count()) // BLOCK_QUERIES)
        part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part")
        some = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("some")
        dealt = rows.join(parts, "list").select("key", "vector", "list", part, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("some"))
        sent = asked.join(parts, "list").select("id", "vector", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), some)
        by = ["list", "part", "some"]
        made = dealt.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(_block(size, limit, ["id", "key", "score"]), f"id {types['id']}, key {types['key']}, score double")
        scored = made.select("id", "key", F.round("score", 6).alias("score"))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= limit)
        return ranked.select(F.col("id").alias(id_col), "rank", F.col("key").alias(self.key), "score")
