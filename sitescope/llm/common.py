"""Shared helpers of the training-data operators: tables, row keys, written intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(1 << 63)  # stands for a null doc_id in row keys; it sorts first


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Number of partitions for keyed exchanges: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent, a local folder serves under a local master
    only; on a cluster the missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile
        root = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the
    lineage, so that a lost executor costs a reread and not a recomputation."""
    path = f"{shared_folder(df.sparkSession)}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_key(doc_id: Column) -> Column:
    """Non-null 64-bit form of an id (null counts as the smallest)."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def text_hash(text: Column, seed: str) -> Column:
    """64-bit text hash; other seeds give independent ones."""
    return F.xxhash64(F.lit(seed), F.coalesce(text, F.lit("")))


def identity(doc_id: Column, text: Column) -> list[Column]:
    """did, k1, k2: an identity of rows by id and text, 127 hash bits beside the
    id. The lowest bit of k1 tells a null id, whose did is the smallest number."""
    doc_id = doc_id.cast("long")
    k1 = text_hash(text, "a").bitwiseAND(F.lit(-2)).bitwiseOR(doc_id.isNull().cast("long"))
    return [doc_key(doc_id).alias("did"), k1.alias("k1"), text_hash(text, "b").alias("k2")]


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """did, k1, k2 and the text, null as empty."""
    return [*identity(df[id_col], df[text_col].cast("string")), plain_text(df, text_col).alias("text")]


def key_id() -> Column:
    """The id behind a row key."""
    return F.when(F.col("k1").bitwiseAND(F.lit(1)) == 0, F.col("did"))


def plain_text(df: DataFrame, column: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, k1, k2, text), hash-partitioned by did: the frame that results per
    document are joined to. Repeated uses in one plan share one exchange.

    Rows with equal id and text count as one document and get equal results;
    rows with equal id and other text are ordered by the text's hash.
    """
    return docs.select(*row_key(docs, id_col, text_col)).repartition(width(docs.sparkSession), "did")
