"""Pending work, batch plans, progress and rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalume.adapters import stored
from catalume.functions import paths

#: Ids of one slice when rows are numbered inside a group.
SLICE_IDS = 1 << 16
NESTED_BATCH, ARCHIVE_BATCH, EMBED_BATCH, STAGED_FROM = 8, 16, 32, 3
ALPHA = 0.1


def pending(assets: DataFrame, metadata: DataFrame, asset_type: str) -> DataFrame:
    """The assets of a type without a metadata row, in the order of their places."""
    out = assets.where(F.col("asset_type") == asset_type).join(metadata.select(F.col("asset_id").alias("id")), "id", "left_anti")
    return out.orderBy(F.col("folder_id"), "rel_path", F.col("zip_file").asc_nulls_first(), F.col("zip_entry").asc_nulls_first(), "id")


def needs_thumbnail(assets: DataFrame, images: DataFrame, worker: bool = False, small: int = 128) -> DataFrame:
    """Images without metadata, or without a thumbnail and not small. The worker leaves out plain archive entries stored as they are."""
    known = images.select(F.col("asset_id").alias("id"), F.lit(True).alias("__known"), F.col("thumbnail_data").isNotNull().alias("__thumb"), ((F.col("width") <= small) & (F.col("height") <= small)).alias("__small"))
    out = assets.where("asset_type = 'image'").join(known, "id", "left")
    wanted = F.col("__known").isNull() | (~F.col("__thumb") & ~F.coalesce("__small", F.lit(False)))
    if worker:
        nested = F.contains(F.lower("zip_entry"), F.lit(".zip/"))
        wanted = wanted & ~(F.col("zip_entry").isNotNull() & ~nested & F.coalesce(F.col("zip_compression") == "store", F.lit(False)))
    return out.where(wanted).select(*assets.columns)


def pending_counts(assets: DataFrame, images: DataFrame, audio: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(category, n) of image, audio and clap."""
    each = [pending(assets, m, t).select(F.lit(c).alias("category")) for c, m, t in (("image", images, "image"), ("audio", audio, "audio"), ("clap", embeddings, "audio"))]
    return each[0].union(each[1]).union(each[2]).groupBy("category").agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, key: str, name: str, order: str = "id") -> DataFrame:
    """rows with `name` (their number inside their key, from 0, by the integer `order`) and group_size.

    A key's rows are numbered by slices of SLICE_IDS values of `order`, after the counts of
    the slices before, so a key that holds a third of all rows is not one task.
    """
    sliced = rows.withColumn("__slice", F.floor(F.col(order) / SLICE_IDS))
    sizes = sliced.groupBy(key, "__slice").agg(F.count("*").alias("__n"))
    own = Window.partitionBy(key)
    before = own.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(key).alias("__key"), F.col("__slice").alias("__own"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(own).alias("group_size"))
    place = F.row_number().over(Window.partitionBy(key, "__slice").orderBy(order)) - 1
    out = sliced.withColumn("__place", place).join(sizes, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__slice") == F.col("__own")))
    return out.withColumn(name, F.col("__before") + F.col("__place")).drop("__slice", "__own", "__key", "__place", "__before")


def batch_plan(work: DataFrame) -> DataFrame:
    """work with kind (file, archive, nested), group_key, group_size, batch and staged.

    Nested archives in batches of 8, archives of 16, files alone; a group is staged from
    three batches on. Rows are numbered by id inside their group.
    """
    place = F.concat_ws("/", F.col("folder_id").cast("string"), F.nullif(F.col("rel_path"), F.lit("")), F.col("zip_file"))
    nested = F.when(F.col("zip_file").isNotNull(), paths.nested_key(place, F.col("zip_entry")))
    kind = F.when(nested.isNotNull(), "nested").when(F.col("zip_file").isNotNull(), "archive").otherwise("file")
    key = F.coalesce(nested, F.when(F.col("zip_file").isNotNull(), place), F.concat(F.lit("file:"), F.col("id").cast("string")))
    size = F.when(F.col("kind") == "nested", NESTED_BATCH).when(F.col("kind") == "archive", ARCHIVE_BATCH).otherwise(1)
    out = numbered(work.withColumn("kind", kind).withColumn("group_key", key), "group_key", "__at").withColumn("batch", F.floor(F.col("__at") / size).cast("bigint")).drop("__at")
    return out.withColumn("staged", F.ceil(F.col("group_size") / size) >= STAGED_FROM)


def embed_batches(work: DataFrame) -> DataFrame:
    """work with group_key (the archive; null for all plain files together, whatever their folder) and batch: 32 rows, never over a key."""
    place = F.concat_ws("/", F.col("folder_id").cast("string"), F.nullif(F.col("rel_path"), F.lit("")), F.col("zip_file"))
    keyed = work.withColumn("group_key", F.when(F.col("zip_file").isNotNull(), F.coalesce(paths.nested_key(place, F.col("zip_entry")), place)))
    return numbered(keyed, "group_key", "__at").withColumn("batch", F.floor(F.col("__at") / EMBED_BATCH).cast("bigint")).drop("__at", "group_size")


def group_order(plan: DataFrame) -> DataFrame:
    """(kind, group_key, group_size, batches, staged): nested groups first and by size, the largest first, then archives and files by key."""
    groups = plan.groupBy("kind", "group_key").agg(F.max("group_size").alias("group_size"), (F.max("batch") + 1).alias("batches"), F.max("staged").alias("staged"))
    rank = F.when(F.col("kind") == "nested", 0).when(F.col("kind") == "archive", 1).otherwise(2)
    return groups.orderBy(rank, F.when(F.col("kind") == "nested", -F.col("group_size")), "group_key")


def progress(rows: DataFrame) -> DataFrame:
    """(category, total, done, failed) from rows with category and status."""
    return rows.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))


def _cut(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows, stored, with __part: ranges of (key, order) of about equal size, so a key that holds a third of all rows has many parts."""
    return stored(rows.repartitionByRange(F.col(key).asc_nulls_first(), *order).withColumn("__part", F.spark_partition_id()), "ranges")


def _with_part_before(rows: DataFrame, key: str, own: Column, name: str, before: Column) -> DataFrame:
    """rows of `_cut` with what the key's parts before leave behind: `own` is aggregated for each part, `before` is taken over these, one row a part."""
    parts = rows.groupBy(key, "__part").agg(own.alias("__own")).withColumn(name, before).select(F.col(key).alias("__key"), F.col("__part").alias("__at"), name)
    return rows.join(parts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at"))).drop("__key", "__at")


def tick_delta(ticks: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """ticks with delta: what came since the tick before, never negative; the first tick's own value.

    A key's ticks are dealt by ranges; the first tick of a range takes the last one of the
    range before. Ticks of one key and order come in any order.
    """
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    rows = _with_part_before(_cut(ticks, key, order), key, last, "__last", F.lag("__own").over(Window.partitionBy(key).orderBy("__part")))
    spec = Window.partitionBy(key, "__part").orderBy(*order)
    before = F.when(F.row_number().over(spec) == 1, F.col("__last")["v"]).otherwise(F.lag(value).over(spec))
    return rows.withColumn("delta", F.greatest(F.lit(0).cast("double"), F.col(value) - F.coalesce(before, F.lit(0.0)))).drop("__part", "__last")


def running_total(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows with `name`, the sum of the key's values up to and with the row; a key's rows are summed in parts, after the totals of the parts before."""
    before = F.sum("__own").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    cut = _with_part_before(_cut(rows, key, order), key, F.sum(value), "__total", F.coalesce(before, F.lit(0)))
    spec = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn(name, F.sum(value).over(spec) + F.col("__total")).drop("__part", "__total")


def _folded(values: np.ndarray, alpha: float) -> tuple[int, float, float, float]:
    """What a run of ticks does to a rate: (ticks, factor of a rate before, addition to it, the rate from 0 on)."""
    n, first = len(values), int(np.argmax(values != 0))
    fade = (1 - alpha) ** np.arange(n - 1, -1, -1.0)
    return n, (1 - alpha) ** n, float(alpha * (values * fade).sum()), float(values[first] * fade[first] + alpha * (values[first + 1 :] * fade[first + 1 :]).sum())


def ewma(ticks: DataFrame, key: str, order: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """(key, n, rate): an exponential moving average in tick order, seeded by the first value that is not 0; null is 0.

    The rate stays 0 until a value is not 0, and that value becomes the rate. Ticks are dealt
    by ranges of key and order; each part of a key's ticks is folded to four numbers, and a
    key's parts, no more than there are tasks, are combined in order.
    """
    kind = ticks.schema[key].dataType.simpleString()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, runs = TaskContext.get().partitionId(), []
        for frame in frames:
            keys, values = frame[key].astype(object).where(frame[key].notna(), None).to_numpy(), frame["__v"].to_numpy(float)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo < hi:
                    n, factor, plus, fresh = _folded(values[lo:hi], alpha)
                    if runs and runs[-1][0] == keys[lo]:
                        _, m, f, p, z = runs.pop()
                        n, factor, plus, fresh = n + m, factor * f, p * factor + plus, (z * factor + plus if z else fresh)
                    runs.append((keys[lo], n, factor, plus, fresh))
            yield from ()
        if runs:
            yield pd.DataFrame(runs, columns=[key, "n", "factor", "plus", "fresh"]).assign(part=part)

    dealt = ticks.select(key, *order, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__v")).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    parts = dealt.select(key, "__v").mapInPandas(fold, f"{key} {kind}, n bigint, factor double, plus double, fresh double, part int")
    own = parts.groupBy(key).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "factor", "plus", "fresh"))).alias("__p"))
    step = lambda r, p: F.when(r == 0, p["fresh"]).otherwise(r * p["factor"] + p["plus"])
    return own.select(key, "n", F.aggregate("__p", F.lit(0.0), step).alias("rate"))


def eta_seconds(total: Column, processed: Column, rate: Column, running: Column) -> Column:
    """Whole seconds left at the rate; null when paused, nothing is processed, or the rate is 0."""
    return F.when(running & (processed > 0) & (rate > 0), F.ceil((total - processed) / rate))


def sliding_rate(events: DataFrame, key: str, millis: Column, success: Column, width: int = 5) -> DataFrame:
    """events with rate: the successes strictly later than `width` seconds ago, a second.

    The sum over a window is the difference of two running totals, at its end and at its
    beginning; both are looked up in one order of times and beginnings, so neither a long
    window nor a key of very many events is one task. Rows whose time is null have no rate.
    """
    own = events.withColumn("__ms", millis.cast("bigint"))
    sums = own.where("__ms is not null").groupBy(F.col(key).alias("key"), "__ms").agg(F.coalesce(F.sum(success.cast("int")), F.lit(0)).cast("bigint").alias("s"))
    # At equal times the events come before the beginnings, which are exclusive.
    both = sums.select("key", F.explode(F.array(F.struct(F.col("__ms").alias("at"), F.lit(0).alias("probe"), "s"), F.struct((F.col("__ms") - width * 1000).alias("at"), F.lit(1).alias("probe"), F.lit(0).cast("bigint").alias("s")))).alias("x"))
    totals = running_total(both.select("key", "x.*"), "key", ["at", "probe"], "s", "total")
    ms = F.when(F.col("probe") == 1, F.col("at") + width * 1000).otherwise(F.col("at"))
    rates = totals.groupBy(F.col("key").alias("__key"), ms.alias("__at")).agg((F.sum(F.when(F.col("probe") == 1, -F.col("total")).otherwise(F.col("total"))) / float(width)).alias("rate"))
    return own.join(rates, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__ms") == F.col("__at")), "left").select(*events.columns, "rate")


def latest_requests(requests: DataFrame, most: int = 48) -> DataFrame:
    """The newest requests first, each id once, cancelled ones left out: a bounded stack."""
    last = requests.groupBy("id").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))
    return last.where("action = 'request'").orderBy(F.desc("seq")).limit(most)


#: Rows of one key among which a median is picked by sorting, and buckets of a pass that narrows down to them.
SELECT_ROWS, SELECT_BUCKETS = 1 << 16, 64


def _at_ranks(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(key, rank, v): the rank-th smallest of each key's values (key, v), by passes that count into buckets.

    A pass cuts a key's values at approximate quantiles, counts exactly between the cuts and
    keeps the bucket that holds the rank, until it has SELECT_ROWS values or one value alone;
    so no task holds or sorts a key's values. The least and the largest value have buckets
    of their own, so every pass gets on. Order: -inf, numbers, inf, NaN.
    """
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    bounds = values.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"))
    state = stored(ranks.select("key", "rank", F.col("rank").alias("want"), F.lit(False).alias("odd")).join(bounds, "key"), "ranks")
    within = finite & F.col("v").between(F.col("lo"), F.col("hi"))
    first = True
    while first or state.where(~F.col("odd") & (F.col("lo") < F.col("hi")) & (F.col("n") > SELECT_ROWS)).limit(1).count():
        # On the first pass every key goes, so that infinities and NaN are told from numbers.
        active = state if first else state.where(~F.col("odd") & (F.col("lo") < F.col("hi")) & (F.col("n") > SELECT_ROWS))
        rows = values.join(active.drop("n", "odd"), "key").where(F.lit(True) if first else within)
        share = [k / SELECT_BUCKETS for k in range(1, SELECT_BUCKETS)]
        cuts = stored(rows.groupBy("key", "rank").agg(F.percentile_approx(F.when(finite, F.col("v")), share, 1000).alias("cuts")), "cuts")
        place = F.when(F.col("v") == F.col("hi"), SELECT_BUCKETS + 1).when(F.col("v") == F.col("lo"), 0).otherwise(1 + F.size(F.filter("cuts", lambda c: c < F.col("v"))))
        bucket = F.when(F.isnan("v"), SELECT_BUCKETS + 3).when(F.col("v") == float("inf"), SELECT_BUCKETS + 2).when(F.col("v") == float("-inf"), -1).otherwise(place).cast("int")
        sizes = rows.join(cuts, ["key", "rank"]).groupBy("key", "rank", "want", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        found = sizes.withColumn("upto", F.sum("n").over(Window.partitionBy("key", "rank").orderBy("bucket"))).where("upto >= want and upto - n < want")
        step = found.select("key", "rank", (F.col("want") - F.col("upto") + F.col("n")).alias("want"), ((F.col("bucket") < 0) | (F.col("bucket") > SELECT_BUCKETS + 1)).alias("odd"), "n", "lo", "hi")
        rest = state.join(active.select("key", "rank"), ["key", "rank"], "left_anti").select(*step.columns)
        state, first = stored(step.unionByName(rest), "ranks"), False
    one = state.where(F.col("odd") | (F.col("lo") == F.col("hi"))).select("key", "rank", F.col("lo").alias("v"))
    few = values.join(state.where(~F.col("odd") & (F.col("lo") < F.col("hi"))), "key").where(within)
    picked = few.withColumn("at", F.row_number().over(Window.partitionBy("key", "rank").orderBy("v"))).where("at = want").select("key", "rank", "v")
    return one.unionByName(picked)


def medians(samples: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the exact median of each key's values, see `_at_ranks`; nulls don't count, without values it is null."""
    kinds = samples.select(F.col(key).alias("name")).distinct().withColumn("key", F.xxhash64("name", F.col("name").isNull()))
    values = samples.where(F.col(value).isNotNull()).select(F.xxhash64(F.col(key), F.col(key).isNull()).alias("key"), F.col(value).cast("double").alias("v"))
    middle = values.groupBy("key").agg(F.count("*").alias("n")).select("key", F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))).alias("rank"))
    found = _at_ranks(values, middle).groupBy("key").agg(F.avg("v").alias("median"))
    return kinds.join(found, "key", "left").select(F.col("name").alias(key), "median")


def timing_stats(samples: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, median, least, most, total) of each key's values; n counts rows."""
    v = F.col(value)
    stats = samples.groupBy(key).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"))
    own = medians(samples, key, value).withColumnRenamed(key, "__key")
    return stats.join(own, F.col(key).eqNullSafe(F.col("__key"))).select(key, "n", "mean", "median", "least", "most", "total")
