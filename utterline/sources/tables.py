"""Scans, and sinks whose changes are sets of rows: append, upsert, update, cascade delete."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: File endings that count as audio. Fixed values.
AUDIO = ("wav", "mp3", "ogg", "flac", "aac", "m4a")


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def unique_names(names: Iterable[str]) -> list[str]:
    """c, c.1, c.2, ... for names that repeat."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        out.append(f"{n}.{seen[n]}" if n in seen else n)
        seen[n] = seen.get(n, 0) + 1
    return out


def resolve(df: DataFrame, name: str) -> str | None:
    """The column ``name``, or the first ``name.N``."""
    numbered = sorted((c for c in df.columns if c.startswith(f"{name}.") and c[len(name) + 1 :].isdigit()), key=lambda c: int(c[len(name) + 1 :]))
    return name if name in df.columns else next(iter(numbered), None)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header that has the schema's columns."""
    wanted = spark.createDataFrame([], schema).columns
    require_columns(spark.read.option("header", True).csv(path), wanted)
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def audio_files(spark: SparkSession, folder: str, endings: Iterable[str] = AUDIO, most: int | None = None) -> DataFrame:
    """path, file_name, length and content of audio files, the first ``most`` by path; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings)).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length", "content")
    if most is None:
        return found
    first = found.select("path").orderBy("path").limit(most)  # contents stay where they are
    return found.join(F.broadcast(first), "path", "left_semi")


def found_in(names: DataFrame, name: str, listing: DataFrame, folders: Iterable[str]) -> DataFrame:
    """``names`` with ``path``: that of the file in the first of ``folders`` that has it, null if none does. ``listing`` has path and file_name."""
    place = F.coalesce(*(F.when(F.regexp_replace("path", r"^file:/+", "/").startswith(f.rstrip("/") + "/"), k) for k, f in enumerate(folders)))
    best = listing.withColumn("_k", place).where("_k IS NOT NULL").groupBy(F.col("file_name").alias(name)).agg(F.min_by("path", F.struct("_k", "path")).alias("path"))
    return names.join(best, name, "left")


def jdbc_table(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table of a database; ``partition`` (column, lower, upper, parts) is read by as many tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, low, high, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def find_all(df: DataFrame, order: str | None = None) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(order)) if order else df


def find_by(df: DataFrame, column: str, value) -> DataFrame:
    """The row with the value, or none; the first of several in no order that is promised."""
    return df.where(F.col(column) == F.lit(value)).limit(1)


def find_all_by(df: DataFrame, column: str, values: Iterable | DataFrame) -> DataFrame:
    """Rows with one of the values: a list, or a table whose first column they are."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi")
    return df.where(F.col(column).isin(*values))


def exists(df: DataFrame, column: str, value) -> bool:
    return not df.where(F.col(column) == F.lit(value)).isEmpty()


def appended(df: DataFrame, path: str) -> None:
    """Append rows to a table of files. A table that is there must have the same columns and types."""
    if (old := _there(df.sparkSession, path)) is not None and (wrong := sorted(set(df.dtypes) ^ set(old.dtypes))):
        raise TypeError(f"columns differ: {wrong}")
    (df if old is None else df.select(old.columns)).write.mode("append").parquet(path)


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def ordered(df: DataFrame, dialog: str, *columns: str) -> DataFrame:
    """Rows by dialog and the first of ``columns`` that there are, nulls last."""
    return df.orderBy(*(F.asc_nulls_last(c) for c in (dialog, *columns) if c in df.columns))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``ordinal``, from 1. Numbers are given per range of rows, so no task sees all."""
    keys = [F.asc_nulls_last(c) for c in order]
    placed = df.repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
    return placed.withColumn("_part", part).withColumn("_place", place).join(F.broadcast(sizes.select("_part", "_before")), "_part").withColumn("ordinal", F.col("_before") + F.col("_place") + 1).drop("_at", "_part", "_place", "_before")


def sliced(df: DataFrame, order: str, offset: int, most: int) -> DataFrame:
    """``most`` rows behind the first ``offset``, by ``order``."""
    return df.orderBy(F.asc_nulls_last(order)).offset(offset).limit(most)


def resolved(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Columns renamed to ``names`` where only ``name.N`` is there."""
    found = {n: r for n in names if (r := resolve(df, n)) and r != n}
    return df.toDF(*[next((n for n, r in found.items() if r == c), c) for c in df.columns])


def unprocessed(rows: DataFrame, done: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with a text that have no row in ``done``."""
    return rows.where(F.col(text).isNotNull() & ~F.col(text).isin("", " ")).join(done.select(key), key, "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of ``new``, and of ``old`` what ``new`` has no key of; null keys never match."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).select(old.columns)


def updated(df: DataFrame, changes: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """``columns`` from ``changes`` where they aren't null there; one row of ``changes`` for each key."""
    columns = list(columns)
    c = changes.select(key, *(F.col(n).alias(f"_new_{n}") for n in columns))
    out = df.join(c, key, "left").withColumns({n: F.coalesce(f"_new_{n}", n) for n in columns})
    return out.select(df.columns)


def cascade_deleted(parents: DataFrame, children: DataFrame, grandchildren: DataFrame, gone: DataFrame, key: str, parent_key: str, child_key: str, grandchild_key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the parents in ``gone``, their children and their children's children."""
    ids = gone.select(key).distinct()
    lost = children.join(ids.withColumnRenamed(key, parent_key), parent_key, "left_semi").select(child_key)
    return (parents.join(ids, key, "left_anti"),
            children.join(ids.withColumnRenamed(key, parent_key), parent_key, "left_anti"),
            grandchildren.join(lost.withColumnRenamed(child_key, grandchild_key), grandchild_key, "left_anti"))


def action(known: Column, processed: Column, updated_at: Column, cutoff: Column | None = None, skip_processed: bool = True) -> Column:
    """What a run does with a file: new, continue, skip or reprocess."""
    old = F.lit(False) if cutoff is None else F.coalesce(updated_at < cutoff, F.lit(False))
    redo = old & F.lit(not skip_processed)
    return F.when(~known, "new").when(~processed, "continue").when(redo, "reprocess").otherwise("skip")


def published(df: DataFrame, path: str) -> str:
    """Write a new version of a table and point readers at it; returns its folder.

    The pointer is a file beside the versions that a rename puts in place, so a failed job leaves the old version whole and readers see one or the other.
    """
    spark, version = df.sparkSession, f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    fs, pointer, new = _pointer(spark, path)
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    fs.delete(pointer, False)
    if not fs.rename(new, pointer):
        raise OSError(f"{path} has no new version")
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table that readers are pointed at."""
    fs, pointer, new = _pointer(spark, path)
    found = pointer if fs.exists(pointer) else new  # between delete and rename
    stream = fs.open(found)
    version = bytes(stream.readAllBytes()).decode()
    stream.close()
    return spark.read.parquet(version)


def _pointer(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    pointer, new = p(f"{path.rstrip('/')}/_current"), p(f"{path.rstrip('/')}/_next")
    return pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), pointer, new
