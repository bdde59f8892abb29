"""What the training-data operators share: the shared work folder, tables written there, and table reading."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripweave.session import shared_dir, ship


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """A name like this that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name for expressions, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def append_columns(docs: DataFrame, text: str, run: Callable[[list[str]], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """``docs`` with ``fields`` after its own columns (a column of ``docs`` with such a name goes): ``run`` gets the whole texts of a
    batch, null as empty, and gives the new columns. Rows stay as they are, also repeated ones and those without an id. Columns may
    have any names: they go through Python under numbers."""
    ship(docs.sparkSession)
    names = {f.name for f in fields}
    kept = [f for f in docs.schema.fields if f.name not in names]
    inner = [f"c{i}" for i in range(len(kept) + len(fields))]
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(inner, kept + fields, strict=True)])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            *columns, body = batch.columns
            yield pa.RecordBatch.from_arrays([*columns, *run(body.to_pylist())], inner)

    body = F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("body")
    rows = docs.select(*(docs[quoted(f.name)].alias(c) for f, c in zip(kept, inner, strict=False)), body)
    return rows.mapInArrow(batches, schema).toDF(*(f.name for f in kept + fields))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds. Null ids are in fold -1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(-1).cast("long"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_label: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``per_label`` labelled documents of each label 0 and 1, chosen by a hash of the id. Of an id with several texts the one of
    the least hash stands, and of its labels the largest."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    # Only ids that the documents have; the id columns alone are read.
    rows = rows.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for k in (0, 1)]
    sample = written(chosen[0].unionByName(chosen[1]), "sample")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
