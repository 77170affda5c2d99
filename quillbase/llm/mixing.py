"""Operator 12, mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Sources, in the order of their code points (null last), weigh as a repeating list says and share a part of all sizes (words).
Each source's target is at most so many times its size; what a clamped source leaves goes to the others by weight. All
sources lie under one level, the words of a unit of weight: a source is clamped if its weight times the level passes its
cap. Each round sums, over the sources, the caps of the clamped and the weights of the others, which gives the next level; it
only rises, and stands when no further source is clamped. Comparisons are of integers.

A source's documents are all taken as often as its target holds its size, and once more in a seeded order (the MD5 of seed, id
and text) until the target is reached; the document at which it is reached is taken in part, by its first words. The sums up to
a document come from sums over ranges of that order, so that no source is sorted as a whole. Rows of the same id and text
share what the order leaves them as evenly as whole words allow.

Everything is DataFrame operations. A null text has no words; a null source is a source; null ids are as an empty id. Documents
and sources without words take nothing. Texts are read whole. A kept column with the name of a result gives way to it;
other columns are dropped. An empty table gives an empty result. Counts of words may reach 10**17.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed by the task: weights in the order of sources, and how often a source may be repeated.
WEIGHTS, MOST = (5, 2, 1), 3
SEED = "mix"
#: The seeded order is summed over so many leading hexadecimal digits of its codes.
DIGITS = 3
#: A list of up to so many sources is broadcast.
MAX_BROADCAST = 100_000

_WIDE = "decimal(38,0)"


def _by_source(left: DataFrame, right: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """A join on the source, in which null equals null."""
    other = right.withColumnRenamed("_source", "_of")
    return left.join(F.broadcast(other) if few else other, F.col("_source").eqNullSafe(F.col("_of")), how).drop("_of")


def weighed(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Sources with their weights. Dealt by ranges and numbered within them, moved on by the counts of the ranges before."""
    order = (F.isnull("_source"), F.col("_source"))
    dealt = stored(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as ranges
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    listed = F.array(*map(F.lit, weights))
    return dealt.join(counts.select("_part", before.alias("_before")), "_part").select("_source", "source_size", F.get(listed, (place % len(weights)).cast("int")).alias("_weight"))


def filled(sources: DataFrame, total: int, most: int) -> DataFrame:
    """Sources (with source_size and _weight) with their targets, which add up to total as far as the caps allow."""
    cap = (F.col("source_size") * most).cast("decimal(19,0)")
    rest, weight = total, None
    clamped = F.lit(False)
    while True:
        sums = sources.agg(F.sum(F.when(clamped, cap)).cast(_WIDE).alias("caps"), F.sum(F.when(~clamped, F.col("_weight"))).alias("weight")).first()
        now = total - int(sums.caps or 0), int(sums.weight or 0)
        if now == (rest, weight) or not now[1]:
            break
        rest, weight = now
        clamped = F.col("_weight").cast("decimal(10,0)") * F.lit(rest).cast("decimal(27,0)") > cap * F.lit(weight).cast("decimal(18,0)")
    level = F.col("_weight") * F.lit(float(rest)) / F.lit(float(weight or 1))
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(level))


def _in_order(docs: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Sources with _whole, and the code at which their last repetition ends, the words left for its _copies rows, and their number."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = sources.withColumn("_whole", whole).withColumn("_extra", F.floor("target") - F.col("_whole") * F.col("source_size"))
    lead = F.substring("_code", 1, DIGITS)
    until = lambda key: F.coalesce(F.sum("_sum").over(Window.partitionBy("_source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = docs.groupBy("_source", lead.alias("_lead")).agg(F.sum("size").alias("_sum")).withColumn("_before", until("_lead"))
    meets = (F.col("_before") < F.col("_extra")) & (F.col("_extra") <= F.col("_before") + F.col("_sum"))
    border = _by_source(ranges, plan.select("_source", "_extra"), few).where(meets).select("_source", "_lead", "_before", "_extra")
    inner = _by_source(docs.withColumn("_lead", lead), border.withColumnRenamed("_lead", "_at"), few).where("_lead = _at")
    codes = inner.groupBy("_source", "_code", "_before", "_extra").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_copies"))
    codes = codes.withColumn("_before", F.col("_before") + until("_code")).where(meets)
    ends = codes.select("_source", F.col("_code").alias("_end"), (F.col("_extra") - F.col("_before")).alias("_left"), "_copies")
    return _by_source(plan, ends, few, "left")


def _numbers(docs: DataFrame) -> DataFrame:
    """Rows of one code in each source, numbered from 0: within the parts they come in, moved on by the counts of the parts before."""
    counts = docs.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_source").alias("_of"), F.col("_part").alias("_in"), before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_row")) - 1
    placed = docs.withColumn("_local", local).join(offsets, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in")))
    return placed.select("_row", (F.col("_local") + F.col("_before")).alias("_number"))


def with_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = ("doc_id",),
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.0,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """For each row size, source_size, target, taken, copies (whole repetitions) and part (words of one more, from the first)."""
    names = {"size", "source_size", "target", "taken", "copies", "part"}
    kept = {c: f"_k{i}" for i, c in enumerate(c for c in keep if c not in names)}
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    code = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text).cast("binary"))
    docs = df.select(
        *[F.col(f"`{c}`").alias(k) for c, k in kept.items()],
        F.col(f"`{source_col}`").cast("string").alias("_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        code.alias("_code"),
        F.monotonically_increasing_id().alias("_row"),
        F.spark_partition_id().alias("_part"),
    )
    docs = stored(docs, "sized")
    sources = weighed(docs.groupBy("_source").agg(F.sum("size").alias("source_size")), weights)
    sources = stored(sources, "weighed")
    n, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    few = n <= MAX_BROADCAST
    plan = stored(_in_order(docs, filled(sources, int(total * share), most), few), "mix")
    placed = _by_source(docs, plan, few)
    even = F.floor(F.col("_left") / F.col("_copies"))
    spare = F.col("_left") - even * F.col("_copies")
    at_end = F.col("_code") == F.col("_end")
    if plan.where((F.col("_copies") > 1) & (spare > 0)).isEmpty():
        further = even
    else:  # some of the rows that are the same at a source's end take one word more
        placed = placed.join(_numbers(placed.where(at_end & (F.col("_copies") > 1)).select("_source", "_part", "_row")), "_row", "left")
        further = even + (F.coalesce(F.col("_number"), F.lit(0)) < spare).cast("long")
    part = F.when(F.col("_end").isNull() | (F.col("_code") > F.col("_end")), 0).when(at_end, F.least(further, F.col("size"))).otherwise(F.col("size"))
    part = part.cast("long")
    return placed.select(
        *[F.col(k).alias(c) for c, k in kept.items()],
        "size",
        "source_size",
        "target",
        (F.col("_whole") * F.col("size") + part).alias("taken"),
        (F.col("_whole") + ((part == F.col("size")) & (F.col("size") > 0)).cast("long")).alias("copies"),
        F.when(part < F.col("size"), part).otherwise(0).alias("part"),
    )


def _first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), F.lit(1), n.cast("int")), " ")


def repeated(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of with_mix(..., keep=(..., text)), each as often as the mix takes it; a part is its first words, single-spaced."""
    n = F.col("copies") + (F.col("part") > 0).cast("long")
    rows = mixed.where(n > 0).withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    return rows.withColumn(text_col, F.when(F.col("repetition") > F.col("copies"), _first_words(F.col(text_col), F.col("part"))).otherwise(F.col(text_col)))


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_mix(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS code FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source) AS k,
    (SELECT sum(source_size) FROM s) - sum(cap) OVER (ORDER BY cap / w, source) + cap AS rest, (SELECT sum(w) FROM w) - sum(w) OVER (ORDER BY cap / w, source) + w AS weight FROM w),
l AS (SELECT rest, weight FROM o WHERE w * rest <= cap * weight ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN w.w * l.rest > cap * l.weight THEN CAST(cap AS DOUBLE) ELSE w.w * CAST(l.rest AS DOUBLE) / CAST(l.weight AS DOUBLE) END AS target FROM w, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, CAST(floor(target) AS BIGINT) - whole * source_size - (sum(size) OVER (PARTITION BY d.source ORDER BY code ROWS UNBOUNDED PRECEDING) - size) AS words
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
x AS (SELECT *, CAST(least(size, greatest(0, words)) AS BIGINT) AS more FROM r)
SELECT doc_id, size, source_size, target, whole * size + more AS taken, whole + CAST(more = size AND size > 0 AS BIGINT) AS copies, CASE WHEN more < size THEN more ELSE 0 END AS part FROM x
"""
