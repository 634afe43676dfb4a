"""Point lookups by id in large stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.checks import known

# Fixed value: what a row group of a lookup table holds at most, in bytes.
ROW_GROUP_BYTES = 4 << 20
# A longer list of ids is joined instead of being pushed down.
FILTER_IDS = 1000


def write_lookup(table: DataFrame, path: str, key: str, distinct_per_file: int = 1_000_000) -> None:
    """Store ``table`` for lookups by ``key``: ascending files, Bloom filters on the key.

    Ids in range leave by the smallest and largest value of a row group, the rest by its filter;
    a skewed key spreads over several files, since ranges are cut on the key and a hash of the row.
    ``distinct_per_file`` sizes the filters.
    """
    rest = F.xxhash64(*table.columns)
    (
        table.repartitionByRange(F.col(key), rest).sortWithinPartitions(key)
        .write.mode("overwrite")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct_per_file))
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .parquet(path)
    )


def look_up(spark: SparkSession, path: str, key: str, ids: list[str], schema=None) -> DataFrame:
    """The rows of ``ids``, which are pushed down to the files; an id without a row is an error.

    Duplicate and null ids are asked once and not at all. For ids that are themselves a table
    use ``look_up_all``.
    """
    wanted = sorted({i for i in ids if i is not None})
    if len(wanted) > FILTER_IDS:
        raise ValueError(f"at most {FILTER_IDS} ids are pushed down; join a table of ids with look_up_all")
    stored = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    asked = spark.createDataFrame([(i,) for i in wanted], "asked string")
    # The values carry the stored type, so that the filter is pushed down and not cast per row.
    kind = stored.schema[key].dataType
    return _attached(asked, stored.where(F.col(key).isin([F.lit(i).cast(kind) for i in wanted])), key)


def look_up_all(ids: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The rows of every distinct id of the one-column table ``ids``; unknown ids are an error."""
    return _attached(ids.toDF("asked").where("asked is not null").distinct(), stored, key)


def _attached(asked: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    found = stored.withColumn("__there", F.lit(True))
    joined = asked.join(found, F.col("asked") == F.col(key).cast("string"), "left")
    return joined.where(known(F.col("__there"), key, F.col("asked"))).select(*[F.col(c) for c in stored.columns])
