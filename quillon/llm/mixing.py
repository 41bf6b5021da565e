"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Keys are range-sorted within each source by cutting them at their first hex
digits into ranges, as many as the rows ask for; sums per (source, range) and one prefix sum over those ranges give each range's start, and a
second prefix sum inside a (source, range) gives each document's place. No task ever holds a whole source. Each source
is then cut at its exact budget: whole epochs first, the last epoch up to the word at which the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillon.llm.common import WORD, cut, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Rows of all sources for each range of a source: the number of hex digits of the key that name its range follows the number of rows.
RANGE_ROWS = 1 << 14


def words_in(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def keyed(docs: DataFrame, seed: str) -> DataFrame:
    """docs (doc_id, text, __source) with __size, __key (hash-random) and __tie, which tells texts of one doc_id apart."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return docs.withColumn("__size", words_in(F.col("text"))).withColumn("__key", key).withColumn("__tie", F.xxhash64("text"))


def digits(rows: int) -> int:
    """Hex digits that name a range: with 3 of them a source has 4096 ranges, the least."""
    n = 3
    while rows > RANGE_ROWS << 4 * n and n < 8:
        n += 1
    return n


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """__source, source_size, target of each source from (__source, source_size).

    Sources by code point, null last, have the weights in turn. share times all sizes are given out by weight; a target
    stops at `most` times its source's size and the excess is shared again by weight. The level at which this ends is found
    in closed form: sources reach their stop in the order of stop / weight, so with them sorted so, the level is the
    rest of the total over the rest of the weights at the first source that the level doesn't fill.
    The windows without a key run over one row a source.
    """
    ordered = Window.orderBy(F.col("__source").isNull(), "__source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    filled = Window.orderBy("__ratio", F.col("__source").isNull(), "__source").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("__weight", weight)
        .withColumn("__stop", F.lit(most) * F.col("source_size"))
        .withColumn("__ratio", F.col("__stop") / F.col("__weight"))
        .withColumn("__total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("__weights", F.sum("__weight").over(everything))
        .withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__stop").over(filled), F.lit(0.0))) / (F.col("__weights") - F.coalesce(F.sum("__weight").over(filled), F.lit(0.0))))
        .withColumn("__open", F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(everything))
        .withColumn("target", F.when(F.col("__open").isNull(), F.col("__stop")).otherwise(F.least(F.col("__stop"), F.col("__open") * F.col("__weight"))))
        .select("__source", "source_size", "target")
    )


def placed(rows: DataFrame, narrow: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """rows (keyed()) with source_size, target and taken. narrow: the same rows' __source, __key, __size, as written."""
    name = F.substring("__key", 1, digits(narrow.count()))
    rows, narrow = rows.withColumn("__range", name), narrow.withColumn("__range", name)
    ranges = narrow.groupBy("__source", "__range").agg(F.sum("__size").alias("__in_range"))
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    aims = targets(ranges.groupBy("__source").agg(F.sum("__in_range").alias("source_size")), weights, share, most)
    starts = ranges.withColumn("__start", F.coalesce(F.sum("__in_range").over(before), F.lit(0)))
    starts = starts.join(aims.withColumnRenamed("__source", "__aim"), F.col("__source").eqNullSafe(F.col("__aim"))).select(F.col("__source").alias("__s"), F.col("__range").alias("__r"), "__start", "source_size", "target")
    inside = Window.partitionBy("__source", "__range").orderBy("__key", "doc_id", "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("__at", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    at = at.join(starts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    last = budget - epochs * F.col("source_size") - F.col("__start") - F.col("__at")
    return at.withColumn("__epochs", epochs).withColumn("__last", F.greatest(F.lit(0), F.least(F.col("__size"), last)).cast("long")).withColumn("taken", F.col("__epochs") * F.col("__size") + F.col("__last"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source).

    A null text has size 0; a null source is a source, the last. Rows repeated with one doc_id follow each other. Sources
    without words have target 0. An empty table gives an empty result. Reruns agree: keys depend on seed and doc_id alone.
    """
    narrow = cut(keyed(docs.select("doc_id", "text", F.col("source").alias("__source")), seed).select("doc_id", "__source", "__size", "__key", "__tie"), "mixing")
    return placed(narrow, narrow).select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself, with all columns of docs (doc_id, text, source, any others, whatever they are called): a row for each whole repeat
    and, at the budget's end, one with the first words.

    The one document of a source in which its budget ends has those first words joined by single spaces; a column n_chars, where
    the table has one, is their length there. Documents that the mix doesn't reach go, and so do those without words (null and empty texts among
    them). A null source is a source. Rows repeated with one doc_id follow each other by size and text's hash. An empty table gives an empty result.
    """
    columns = docs.columns
    names = [{"doc_id": "doc_id", "text": "text", "source": "__source"}.get(c, f"c{i}") for i, c in enumerate(columns)]
    held = docs.toDF(*names)
    rows = keyed(held, seed)
    narrow = cut(rows.select("__source", "__key", "__size"), "mixing")
    placed_rows = placed(rows, narrow)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    first = F.array_join(F.slice(words, F.lit(1), F.col("__last").cast("int")), " ")
    whole = F.col("__epochs") + (F.col("__last") == F.col("__size")).cast("long")
    copies = F.when(F.col("taken") == 0, F.array().cast("array<boolean>")).otherwise(
        F.concat(F.array_repeat(F.lit(True), whole.cast("int")), F.when((F.col("__last") > 0) & (F.col("__last") < F.col("__size")), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    )
    out = placed_rows.withColumn("__whole", F.explode(copies)).withColumn("__text", F.when(F.col("__whole"), F.col("text")).otherwise(first))
    new = {"text": F.col("__text")}
    if "n_chars" in columns:
        i = columns.index("n_chars")
        new["n_chars"] = F.when(F.col("__whole"), F.col(names[i])).otherwise(F.length("__text").cast(held.schema[i].dataType))
    return out.select(*[new.get(c, F.col(n)).alias(f"k{i}") for i, (c, n) in enumerate(zip(columns, names))]).toDF(*columns)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS stop
  FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
o AS (SELECT *, max(CASE WHEN level <= stop / weight THEN level END) OVER () AS open FROM l),
t AS (SELECT source, source_size, CASE WHEN open IS NULL THEN stop ELSE least(stop, open * weight) END AS target FROM o),
a AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM a
"""
