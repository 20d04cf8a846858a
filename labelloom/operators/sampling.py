"""Seeded sampling of exact sizes, without sorting a class or the table in one task.

"Random" here means ordered by an md5 of seed and id, so that a sample can be repeated.
To take the lowest ``k`` keys of a group, nested histograms find the key that the sample ends
with. One aggregate over the table counts each group per leading ``DIGITS`` digits of the key
(combined before the shuffle), which gives the sizes of the groups and, for each, the bucket the
k-th key lies in. Only the keys of those buckets are written down, and cut in the same way
until a group's part can be ranked. The sample is then a comparison with that key, made where
the rows are: three reads of the table, whatever its size.

A row meets the limit of its group in a join whose key is the group and a salt of the row's own
key, so a class with a third of all rows is dealt over ``SALTS`` tasks where the join is a shuffle
at all. No text is ever shuffled, and no table is held by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions.text import seeded_order
from labelloom.operators.classes import require_class_count
from labelloom.session import release, stored
from labelloom.sizing import local_frame

# Hex digits of the key that one level looks at, and digits of an md5.
DIGITS = 2
KEY_DIGITS = 32
# Keys of one group that are ranked together.
RANKED_ROWS = 1 << 16
SALTS = 32
# Fixed value: how a missing label is named as a class of its own.
NULL_CLASS = "NaN"


def _bucket(key: Column, level: int) -> Column:
    """The digits of the key that a level looks at, and those before them."""
    return F.substring(key, 1, (level + 1) * DIGITS)


def key_histogram(df: DataFrame, group: str, key: Column) -> DataFrame:
    """Rows per group and leading digits of the key (group, _b, _n), stored."""
    counted = df.groupBy(group, _bucket(key, 0).alias("_b")).agg(F.count("*").alias("_n"))
    return stored(counted, "key-histogram")


def group_sizes(histogram: DataFrame, group: str) -> DataFrame:
    return histogram.groupBy(group).agg(F.sum("_n").alias("n"))


def _boundary(histogram: DataFrame, takes: DataFrame, group: str) -> DataFrame:
    """(group, _b, _left): the bucket in which a group's sample ends, and how many of its rows are still taken."""
    upto = F.sum("_n").over(W.partitionBy(group).orderBy("_b"))
    met = histogram.join(takes, group).withColumn("_upto", upto)
    ends = met.filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
    return ends.select(group, "_b", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"))


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def _salt() -> Column:
    """Never null, so that the join adds no filter that would compute the key once more."""
    return F.coalesce(F.pmod(F.xxhash64("_h"), F.lit(SALTS)), F.lit(0).cast("bigint"))


def mark_lowest(
    df: DataFrame, group: str, key: Column, histogram: DataFrame, quotas: DataFrame, by_content: bool = False
) -> DataFrame:
    """Add ``chosen``: true for the ``take`` lowest keys of each group.

    ``quotas(group, n, take)`` has one row per group with its size; ``histogram`` is that of the
    same rows and key. Where a sample ends among rows of one key (repeated or missing ids), these
    are told apart in the same way by their content; rows that agree in everything stand for each other.
    """
    quotas = stored(quotas, "quotas")
    takes = quotas.filter("take > 0 and take < n").select(group, F.col("take").alias("_left"))
    boundary = stored(_boundary(histogram, takes, group), "boundary")
    keys = df.select(group, key.alias("_h")).select(group, "_h", _bucket(F.col("_h"), 0).alias("_b"), _salt().alias("_salt"))
    left = stored(keys.join(_salted(boundary), [group, "_b", "_salt"]).select(group, "_h", "_left"), "boundary-keys")
    release(boundary)
    for level in range(1, KEY_DIGITS // DIGITS):
        rows = left.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if rows <= RANKED_ROWS:
            break
        cut = left.withColumn("_b", _bucket(F.col("_h"), level))
        counted = cut.groupBy(group, "_b").agg(F.count("*").alias("_n"))
        takes = left.groupBy(group).agg(F.first("_left").alias("_left"))
        inner = _salted(_boundary(counted, takes, group))
        finer = cut.drop("_left").withColumn("_salt", _salt()).join(inner, [group, "_b", "_salt"])
        finer = stored(finer.select(group, "_h", "_left"), "boundary-keys")
        release(left)
        left = finer
    # equal keys are one row here, however many rows share them
    distinct = left.groupBy(group, "_h").agg(F.count("*").alias("_n"), F.first("_left").alias("_left"))
    ranked = distinct.withColumn("_upto", F.sum("_n").over(W.partitionBy(group).orderBy("_h")))
    last = ranked.filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left"))).select(
        group,
        F.col("_h").alias("_last"),
        F.col("_n").alias("_there"),
        (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_wanted"),
        (F.col("_left") < F.col("_upto")).alias("_split"),
    )
    limits = stored(quotas.join(last, group, "left"), "limits")
    release(quotas, left)
    inside = (F.col("_h") < F.col("_last")) | ((F.col("_h") == F.col("_last")) & ~F.col("_split"))
    inside = (F.col("take") >= F.col("n")) | ((F.col("take") > 0) & inside)
    marked = df.withColumn("_h", key).withColumn("_salt", _salt()).join(_salted(limits), [group, "_salt"])
    marked = marked.withColumn("chosen", F.coalesce(inside, F.lit(False)))
    columns = [*df.columns, "chosen"]
    if limits.filter("_split").isEmpty():
        return marked.select(columns)
    torn = F.coalesce(F.col("_split") & (F.col("_h") == F.col("_last")), F.lit(False))
    if by_content:
        # equal rows at the very end of a sample: any of them will do
        order = W.partitionBy(group).orderBy("_h")
        told = marked.filter(torn).withColumn("chosen", F.row_number().over(order) <= F.col("_wanted")).select(columns)
    else:
        rows = marked.filter(torn).select(df.columns)
        content = F.md5(F.xxhash64(*df.columns).cast("string"))
        inner = key_histogram(rows, group, content)
        wanted = limits.filter("_split").select(group, F.col("_there").alias("n"), F.col("_wanted").alias("take"))
        told = mark_lowest(rows, group, content, inner, wanted, by_content=True)
        release(inner)
    return marked.filter(~torn).select(columns).unionByName(told)


def take_lowest(df: DataFrame, n: int, key: Column, of: int) -> DataFrame:
    """The ``n`` rows with the lowest keys among all ``of`` rows."""
    quota = local_frame(df.sparkSession, [("all", of, n)], "_all string, n bigint, take bigint")
    whole = df.withColumn("_all", F.lit("all"))
    histogram = key_histogram(whole, "_all", key)
    marked = mark_lowest(whole, "_all", key, histogram, quota).filter("chosen").drop("_all", "chosen")
    release(histogram)
    return marked


def _full_cycles(counts: DataFrame, size: int) -> tuple[int, int, int]:
    """Cycles in which every class still gives one row, rows of the cycle after, and all rows.

    Works on the distinct class sizes, of which n rows can have at most sqrt(2n).
    """
    sizes = sorted(counts.groupBy("n").agg(F.count("*").alias("k")).collect(), key=lambda r: r.n)
    n_rows = sum(r.n * r.k for r in sizes)
    spent, alive = 0, sum(r.k for r in sizes)
    for r in sizes:
        # rows used when all classes of at least this size have given r.n rows
        if spent + r.n * alive > size:
            cycles = (size - spent) // alive
            return cycles, size - spent - cycles * alive, n_rows
        spent += r.n * r.k
        alive -= r.k
    return (sizes[-1].n if sizes else 0), 0, n_rows


def balanced_split(df: DataFrame, label: str, size: int, seed: int = 0, id_col: str = "item_id") -> DataFrame:
    """Add ``chosen``: a class-balanced sample of ``size`` rows.

    One row of each class per cycle, in a shuffled order, until the size is reached; a
    class that runs out is passed over. Null labels form a class. A size of at least
    the table takes everything. ``chosen`` false marks the other side of the split.
    """
    classed = df.withColumn("_class", F.coalesce(F.col(label).cast("string"), F.lit(NULL_CLASS)))
    key = seeded_order(seed, F.col(id_col))
    histogram = key_histogram(classed, "_class", key)
    counts = group_sizes(histogram, "_class")
    cycles, rest, _ = _full_cycles(counts, size)
    last_cycle = (
        counts.filter(F.col("n") > cycles)
        .orderBy(seeded_order(seed, F.lit(cycles + 1), F.col("_class")), "_class")
        .limit(rest)
        .select("_class", F.lit(1).alias("extra"))
    )
    quotas = counts.join(last_cycle, "_class", "left").select(
        "_class", "n", (F.least("n", F.lit(cycles)) + F.coalesce("extra", F.lit(0))).alias("take")
    )
    marked = mark_lowest(classed, "_class", key, histogram, quotas).drop("_class")
    release(histogram)
    return marked


def prepare_splits(
    train: DataFrame, valid: DataFrame, test: DataFrame, dev_size: int, label: str = "label", seed: int = 0
) -> DataFrame:
    """dev = balanced sample of train and valid together, train = the rest, test as it is."""
    pool = balanced_split(train.unionByName(valid), label, dev_size, seed)
    named = pool.withColumn("split", F.when(F.col("chosen"), F.lit("dev")).otherwise(F.lit("train"))).drop("chosen")
    return named.unionByName(test.withColumn("split", F.lit("test")))


# The parts that raw files come in.
RAW_SPLITS = ("train", "valid", "test")


def rekeyed(df: DataFrame, part: str) -> DataFrame:
    """Item numbers that are unique over all parts, for parts that are each numbered from 0.

    ``item_id`` becomes 3 * old number + place of the part; the old number and the part stay
    as ``old_id`` and ``old_split``.
    """
    place = RAW_SPLITS.index(part)
    kept = [c for c in df.columns if c != "item_id"]
    return df.select(
        (F.col("item_id") * len(RAW_SPLITS) + place).alias("item_id"),
        F.col("item_id").alias("old_id"),
        F.lit(part).alias("old_split"),
        *kept,
    )


def require_unique_ids(df: DataFrame, id_col: str = "item_id") -> None:
    """Refuse a table in which a number is missing or stands for two items."""
    twice = df.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1)).limit(5).collect()
    if twice:
        raise ValueError(f"item numbers that are missing or not unique, for instance {[r[0] for r in twice]}: use rekeyed()")


def prepare_raw_splits(
    train: DataFrame,
    valid: DataFrame,
    test: DataFrame,
    dev_size: int,
    label: str = "label",
    seed: int = 0,
    n_classes: int | None = None,
) -> DataFrame:
    """Splits of raw parts with numbers of their own each: re-keyed, checked, then prepared.

    With ``n_classes`` every split must hold that many labels.
    """
    parts = [rekeyed(df, part) for df, part in zip((train, valid, test), RAW_SPLITS)]
    for part in parts:
        require_unique_ids(part)
    splits = prepare_splits(*parts, dev_size, label, seed)
    if n_classes is not None:
        require_class_count(splits.withColumn("label", F.col(label)), n_classes)
    return splits


def prepare_splits_from_valid(
    train: DataFrame, valid: DataFrame, test: DataFrame, dev_size: int, label: str = "label", seed: int = 0
) -> DataFrame:
    """dev = balanced sample of valid alone; the rest of valid is not used."""
    dev = balanced_split(valid, label, dev_size, seed).filter("chosen").drop("chosen")
    return (
        train.withColumn("split", F.lit("train"))
        .unionByName(dev.withColumn("split", F.lit("dev")))
        .unionByName(test.withColumn("split", F.lit("test")))
    )


def holdout(df: DataFrame, share: float = 0.1, seed: int = 42, id_col: str = "item_id") -> DataFrame:
    """Add ``held_out``: true for exactly ceil(share * n) rows."""
    whole = df.withColumn("_all", F.lit("all"))
    key = seeded_order(seed, F.col(id_col))
    histogram = key_histogram(whole, "_all", key)
    quotas = group_sizes(histogram, "_all").withColumn("take", F.ceil(F.lit(share) * F.col("n")))
    marked = mark_lowest(whole, "_all", key, histogram, quotas)
    release(histogram)
    return marked.drop("_all").withColumnRenamed("chosen", "held_out")
