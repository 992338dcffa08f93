"""The corpus pipeline: language ID, toxicity, exact dedup, near-dedup, best-fit packing.

Every stage works on the table that its predecessor wrote and returns the rows that it keeps, with the
columns of documents; the last returns the packed pieces. Which rows go:

- language_id: texts without a letter, null and empty texts, and texts that no language profile fits;
- toxicity: texts predicted toxic by a model of the labelled documents that are still there;
- exact_dedup: all rows of a group of equal texts but one (the longest, then the smallest doc_id);
- near_dedup: all rows of a group of linked fingerprints but that of the smallest doc_id.

Rows are told apart by all their columns, so those that share a doc_id or have none are rows of their own: texts alone
decide which go. Nulls come after other doc_ids, and rows of one doc_id in the order of a hash of their columns.
Of rows equal in all columns one stays in the dedup stages. Texts are read whole, however long; an empty table gives
empty tables; further columns of documents stay with their rows up to packing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common, exactdedup, langid, packing, simhash, toxicity


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.session(spark)
    profiles = langid.fit(docs)
    return langid.keep(docs, profiles, langid.floor(docs, profiles))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = common.read(spark, sf_dir, "labels")
    return toxicity.keep(docs, toxicity.learnt(docs, labels))


KEY = "palimpsest row key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a column KEY: doc_id in an order-preserving form, nulls last, and a 128-bit hash of all columns."""
    if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint"):
        place = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    else:
        place = F.concat(F.hex(F.col("doc_id").cast("string")), F.lit(" "))
    # A hash passes nulls over, so it also has which columns are null.
    cells = [*(F.col(c) for c in docs.columns), *(F.col(c).isNull() for c in docs.columns)]
    hashes = [F.lpad(F.hex(F.xxhash64(F.lit(k), *cells)), 16, "0") for k in (0, 1)]
    return docs.withColumn(KEY, F.concat(F.coalesce(F.concat(F.lit("0"), place), F.lit("1")), *hashes))


def _only(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of keyed that are named in the doc_id of rows; of rows equal in all columns one."""
    kept = keyed.join(rows.select(F.col("doc_id").alias(KEY)), KEY, "left_semi")
    repeated = keyed.groupBy(KEY).count().filter("count > 1").limit(1).count()
    return (kept.dropDuplicates([KEY]) if repeated else kept).drop(KEY)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.session(spark)
    keyed = _keyed(docs)
    return _only(keyed, exactdedup.groups(keyed, KEY).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.session(spark)
    keyed = _keyed(docs)
    return _only(keyed, simhash.near_duplicates(keyed, KEY).filter(F.col("doc_id") == F.col("component_id")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.session(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("packing", pack),
]
#: Fitted models, fingerprints and a tokenizer: not for SQL. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as a table and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
