"""Sources and sinks: parquet, JSON and JDBC tables; delta tables that keep the latest row; versioned whole tables; a SQLite reader through Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillon.operators import store


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "append") -> None:
    """Partitioned by columns of few values (namespace), so that a namespace can be read or dropped alone."""
    w = df.write.format(kind).mode(mode)
    (w.partitionBy(*by) if by else w).save(path)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions that were written whole, ascending: those with a success mark."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    found = []
    for s in fs.listStatus(base):
        name = s.getPath().getName()
        if name.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append(int(name[1:]))
    return sorted(found)


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v{versions(spark, root)[-1]}")


def merge(new: DataFrame, root: str, key: str = "id") -> int:
    """Writes the next version of a table: the current one with new rows in place of those with their key."""
    spark = new.sparkSession
    known = versions(spark, root)
    rows = store.upsert(current(spark, root), new, key) if known else new.dropDuplicates([key])
    n = (known[-1] if known else 0) + 1
    rows.write.parquet(f"{root}/v{n}")
    return n


def _folder(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    return jvm.org.apache.hadoop.fs.Path, base, base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def deltas(spark: SparkSession, root: str) -> list[int]:
    """Numbers of a delta table's committed deltas, ascending, from the last compacted one on."""
    path, base, fs = _folder(spark, root)
    if not fs.exists(base):
        return []
    done, whole = [], 0
    for s in fs.listStatus(base):
        name = s.getPath().getName()
        if name.startswith("__delta=") and fs.exists(path(s.getPath(), "_SUCCESS")):
            done.append(int(name[8:]))
            if fs.exists(path(s.getPath(), "_WHOLE")):
                whole = max(whole, done[-1])
    return sorted(n for n in done if n >= whole)


def claim(spark: SparkSession, root: str) -> int:
    """A delta's number that no other writer has: the mark of a number can be made once only."""
    path, base, fs = _folder(spark, root)
    marks = path(base, "_claims")
    fs.mkdirs(marks)
    n = max([0, *(int(s.getPath().getName()) for s in fs.listStatus(marks))])
    while True:
        n += 1
        if fs.createNewFile(path(marks, str(n))):
            return n


def append(rows: DataFrame, root: str, by: str, gone: bool = False) -> int:
    """Adds a delta: rows in place of those with their key, or, if gone, the end of these. Only new files are written, partitioned by `by`."""
    n = claim(rows.sparkSession, root)
    rows.withColumn("__gone", F.lit(gone)).write.partitionBy(by).parquet(f"{root}/__delta={n}")
    return n


def latest(spark: SparkSession, root: str, schema: str, key: list[str]) -> DataFrame:
    """The newest row of each key of a delta table, without those that are gone; filters on the partition column prune files."""
    found = deltas(spark, root)
    if not found:
        return spark.createDataFrame([], schema)
    whole = f"{schema}, __gone boolean, __delta long"
    rows = spark.read.schema(whole).option("basePath", root).parquet(*[f"{root}/__delta={n}" for n in found])
    names = [c for c in rows.columns if c not in ("__gone", "__delta")]
    if len(found) > 1:
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__delta")))).where("__r = 1")
    return rows.where("NOT __gone").select(*[c for c in spark.createDataFrame([], schema).columns if c in names])


def compact(spark: SparkSession, root: str, schema: str, key: list[str], by: str) -> int:
    """Writes the latest rows as one delta that stands for all before it; readers that began earlier keep their files."""
    rows = latest(spark, root, schema, key)
    n = claim(spark, root)
    rows.withColumn("__gone", F.lit(False)).write.partitionBy(by).parquet(f"{root}/__delta={n}")
    path, base, fs = _folder(spark, root)
    fs.createNewFile(path(base, f"__delta={n}/_WHOLE"))
    return n


def sqlite(spark: SparkSession, path: str, table: str, key: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file that all executors can open, in ranges of rowid; columns become strings but for `key`."""
    import sqlite3

    with sqlite3.connect(path) as c:
        names = [r[1] for r in c.execute(f'PRAGMA table_info("{table}")')]
        low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    if low is None:
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    step = -(-(high - low + 1) // parts)

    def run(batches):
        import pandas as pd

        for b in batches:
            for a in b["id"]:
                with sqlite3.connect(path) as c:
                    rows = c.execute(f'SELECT * FROM "{table}" WHERE rowid BETWEEN ? AND ?', (low + a * step, low + (a + 1) * step - 1)).fetchall()
                yield pd.DataFrame([[None if v is None else str(v) for v in r] for r in rows], columns=names, dtype=object)

    return spark.range(parts, numPartitions=parts).mapInPandas(run, ", ".join(f"`{n}` string" for n in names)).withColumn(key, F.col(key))
