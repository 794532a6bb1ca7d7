"""Shared plumbing: staged tables, word counts, running sums and index permutations."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one, but only if all tasks run in the driver's process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textquarry-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/textquarry/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a staged table that no other run uses."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes the staged tables of this application, and of no other; results not yet read are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in text, 0 for null."""
    pieces = F.size(F.split(text, SPACE + "+", -1))
    head = F.when((text == "") | text.rlike("^" + SPACE), 1).otherwise(0)
    tail = F.when(text.rlike(SPACE + r"\z"), 1).otherwise(0)
    return F.when(text.isNull(), 0).otherwise(pieces - head - tail).cast("long")


def buckets_for(rows: int, share: int = 1) -> int:
    """Buckets for `running`: they and the rows in each grow with the square root of all rows."""
    return max(1, math.isqrt(rows) // share)


def running(df: DataFrame, within: list[str], bucket: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds exclusive running sums of `sums`, in the order (bucket, order) inside each `within`.

    Two levels: sums by bucket are added up over the buckets (one small row
    each, all of one `within` in one task), and each bucket's own rows are added
    up in a window. With buckets as many as the root of the rows, neither level
    gives a task more than a small multiple of that root.
    """
    keys = within + bucket
    cast = {k: v.cast("long") for k, v in sums.items()}
    heads = df.groupBy(*keys).agg(*[F.sum(v).alias(f"__t_{k}") for k, v in cast.items()])
    over = Window.partitionBy(*within) if within else Window.partitionBy()
    over = over.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.coalesce(F.sum(f"__t_{k}").over(over), F.lit(0)).alias(f"__b_{k}") for k in cast])
    on = None
    for k in keys:
        same = df[k].eqNullSafe(heads[f"__k_{k}"])
        on = same if on is None else on & same
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.join(heads, on, "left")
    return own.select(*df.columns, *[(F.col(f"__b_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(k) for k, v in cast.items()])


def drawn_unit(*key: Column | str) -> Column:
    """A number from 0 to under 1, by the hash of the key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / float(1 << 52)


def permuted(index: Column, n: Column, key: list[Column], walks: int = 24) -> Column:
    """A keyed pseudorandom permutation of 0..n-1, as an expression.

    Four alternating rounds on Z_p x Z_q with p = ceil(sqrt n) and q = ceil(n / p),
    and a cycle walk back into the range. Fewer than p values lie outside it, so
    up to n = 576 the walk always ends in time; beyond, each step stays outside
    with a chance under 1/24, and 24 in a row do not happen.
    """
    p = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    p = F.greatest(p, F.lit(1).cast("long"))
    q = F.expr("1L") * F.floor((n + p - 1) / p).cast("long")
    q = F.greatest(q, F.lit(1).cast("long"))

    def once(x: Column) -> Column:
        def half(state: Column, r: Column) -> Column:
            a = F.pmod(state["a"] + F.pmod(F.xxhash64(*key, r, F.lit("a"), state["b"]), state["p"]), state["p"])
            b = F.pmod(state["b"] + F.pmod(F.xxhash64(*key, r, F.lit("b"), a), state["q"]), state["q"])
            return F.struct(a.alias("a"), b.alias("b"), state["p"].alias("p"), state["q"].alias("q"))

        start = F.struct((F.floor(x / q).cast("long")).alias("a"), F.pmod(x, q).alias("b"), p.alias("p"), q.alias("q"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(2)]), start, half, lambda s: s["a"] * s["q"] + s["b"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), once(index.cast("long")), lambda x, _: F.when(x >= n, once(x)).otherwise(x))


#: Keys that hold at least one in so many of all rows are heavy; there are at most so many of them.
HEAVY_SHARE = 8192


def key_joined(rows: DataFrame, keys: DataFrame, on: str, total: int) -> DataFrame:
    """rows with the columns of keys: one row for each value of `on`, with n, how many rows hold it; total is the number of all rows.

    Heavy keys, at most HEAVY_SHARE of them whatever the input, go to all tasks,
    so rows that hold them are never dealt out by key. A key that is left holds
    so few rows that a task can take them.
    """
    least = max(1, total // HEAVY_SHARE)
    heavy, light = keys.filter(F.col("n") >= least), keys.filter(F.col("n") < least)
    columns = [*rows.columns, *[c for c in keys.columns if c not in (on, "n")]]
    few = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(light.hint("shuffle_merge"), on).select(*columns)
    return rows.join(F.broadcast(heavy), on).select(*columns).unionByName(few)


def semi_joined(rows: DataFrame, keys: DataFrame, on: str, total: int) -> DataFrame:
    """The rows whose key `on` is among keys (on, n), as key_joined joins them."""
    return key_joined(rows, keys.select(on, "n"), on, total)


FILTER_BITS = 26


def maybe_among(rows: DataFrame, key: Column, ids: DataFrame, name: str) -> DataFrame:
    """rows with a column `name`: false only if the key (a long that is not null) is not in the first column of ids.

    A bitmap of 2 ** FILTER_BITS bits, whatever the number of ids, goes to all
    tasks: 8 MB at most. What it lets through by chance a join must drop.
    """
    slot = F.pmod(F.xxhash64(F.col(ids.columns[0]), F.lit("filter")), F.lit(1 << FILTER_BITS))
    marks = ids.groupBy(F.bitmap_bucket_number(slot).alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__bits"))
    place = F.pmod(F.xxhash64(key, F.lit("filter")), F.lit(1 << FILTER_BITS))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    seen = rows.withColumns({"__part": F.bitmap_bucket_number(place), "__at": at}).join(F.broadcast(marks), "__part", "left")
    hit = F.coalesce(F.getbit(byte, F.pmod("__at", F.lit(8)).cast("int")) == 1, F.lit(False))
    return seen.withColumn(name, hit).select(*rows.columns, name)
