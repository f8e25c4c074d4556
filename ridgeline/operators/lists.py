"""Edits and lookups of ordered lists: renumbering, first matches, free numbers, neighbours, one-to-one maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def renumber(df: DataFrame, keys: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """df with places from 0 in the given order."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def rebind(binds: DataFrame, index: str, deleted: DataFrame, width: int = 4096) -> DataFrame:
    """Indices after rows are deleted: -1 for a deleted row, else less the deleted ones before it. deleted: (idx).

    Deleted rows are counted within bins of `width` indices and over the bins before, so no task or list holds them
    all; only the bins, one row each, are summed in one place. A null index stays null.
    """
    kind = binds.schema[index].dataType
    gone = deleted.select(F.col("idx").alias("_i"), F.lit(1).alias("_gone"))
    asked = binds.select(F.col(index).alias("_i"), F.lit(0).alias("_gone"))
    marks = gone.union(asked).where("_i IS NOT NULL").groupBy("_i").agg(F.max("_gone").alias("_gone")).withColumn("_bin", F.floor(F.col("_i") / width))
    inside = F.sum("_gone").over(Window.partitionBy("_bin").orderBy("_i"))
    bins = marks.groupBy("_bin").agg(F.sum("_gone").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_bin")) - F.col("_n"))
    new = F.when(F.col("_gone") == 1, -1).otherwise(F.col("_i") - F.col("_before") - inside)
    places = marks.join(bins, "_bin").select("_i", new.alias("_new"))
    out = binds.join(places, binds[index] == places["_i"], "left")
    return out.withColumn(index, F.col("_new").cast(kind)).select(*binds.columns)


def first_match(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by min_by: partial aggregation before the exchange, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def lowest_free(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The least number from 1 that a key doesn't have: the first gap among its distinct numbers, without a sequence."""
    taken = df.where(F.col(number) > 0).select(*keys, number).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    free = taken.withColumn("_k", place).groupBy(*keys).agg((F.count(F.when(F.col(number) == F.col("_k"), 1)) + 1).alias("free"))
    return df.select(*keys).distinct().join(free, keys, "left").select(*keys, F.coalesce("free", F.lit(1)).cast("bigint").alias("free"))


def append_absent(saved: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Present rows, then the saved rows that are not among them."""
    return present.unionByName(saved.join(present.select(*on), on, "left_anti").select(*present.columns))


def swap_with_next(df: DataFrame, keys: list[str], seq: str, at: Column) -> DataFrame:
    """df with the row at place `at` moved down by one; a last row stays."""
    last = F.max(seq).over(Window.partitionBy(*keys))
    moved = F.when((F.col(seq) == at) & (at < last), F.col(seq) + 1).when((F.col(seq) == at + 1), F.col(seq) - 1).otherwise(F.col(seq))
    return df.withColumn(seq, moved)


def duplicate(df: DataFrame, seq: str, at: Column) -> DataFrame:
    """df with a copy of the row at place `at` right after it; later rows move down. Local to a row, no exchange."""
    kind = df.schema[seq].dataType
    shift = F.when(F.col(seq) == at, F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col(seq) > at).cast("int")))
    return df.withColumn("_shift", F.explode(shift)).withColumn(seq, (F.col(seq) + F.col("_shift")).cast(kind)).drop("_shift")


def delete_at(df: DataFrame, seq: str, at: Column) -> DataFrame:
    """df without the row at place `at`; later rows move up. Local to a row, no exchange."""
    return df.where(~F.col(seq).eqNullSafe(at)).withColumn(seq, (F.col(seq) - (F.col(seq) > at).cast("int")).cast(df.schema[seq].dataType))


def splice(df: DataFrame, keys: list[str], seq: str, at: int, rows: DataFrame) -> DataFrame:
    """df with rows (the same columns, places from 0) put before place `at` of their key, or at the end of a shorter one."""
    kind = df.schema[seq].dataType
    added = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    sizes = df.groupBy(*keys).agg((F.max(seq) + 1).alias("_size"))
    room = F.when(F.col(seq) >= at, F.coalesce("_n", F.lit(0))).otherwise(0)
    old = df.join(added, keys, "left").withColumn(seq, (F.col(seq) + room).cast(kind)).drop("_n")
    start = F.least(F.lit(at), F.coalesce("_size", F.lit(0)))
    new = rows.join(sizes, keys, "left").withColumn(seq, (F.col(seq) + start).cast(kind))
    return old.unionByName(new.select(*old.columns))


def insert_after(df: DataFrame, keys: list[str], seq: str, selected: int | None, rows: DataFrame) -> DataFrame:
    """df with rows (places from 0) put after the selected place of their key, or at its end where none is selected."""
    return splice(df, keys, seq, (1 << 30) if selected is None or selected < 0 else selected + 1, rows)


def replace_at(df: DataFrame, seq: str, at: Column, values: dict[str, Column]) -> DataFrame:
    """df with new values in the row at place `at`; a place that is not there changes nothing."""
    return df.withColumns({c: F.when(F.col(seq) == at, v).otherwise(F.col(c)) for c, v in values.items()})


def in_bounds(index: Column, size: Column) -> Column:
    """Whether index is a place of a list of that size; null is none."""
    return F.coalesce(index.between(F.lit(0), size - 1), F.lit(False))


def restore(kept: DataFrame, deleted: DataFrame, keys: list[str], seq: str, chosen: Column) -> DataFrame:
    """kept with the chosen rows of deleted at its end, the last deleted first, as they are taken from the end on."""
    back = deleted.where(chosen).withColumn(seq, (F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq))) - 1).cast(kept.schema[seq].dataType))
    return insert_after(kept, keys, seq, None, back)


def first_of_either(df: DataFrame, name: str, order: str, wanted: list) -> DataFrame:
    """The first row, by order, whose name is any of the wanted ones that are not null: a partial minimum, no sort."""
    some = df.where(F.col(name).isin([w for w in wanted if w is not None]))
    return some.agg(F.min_by(F.struct(*df.columns), order).alias("_r")).where("_r IS NOT NULL").select("_r.*")


def distinct_first_seen(df: DataFrame, name: str, order: str) -> DataFrame:
    """(name, first): each name once, with where it was seen first."""
    return df.groupBy(name).agg(F.min(order).alias("first"))


def name_set(df: DataFrame, keys: list[str], name: str, wanted: Column) -> DataFrame:
    """(keys, names, has): the sorted names of a key, and whether the wanted one is among them."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("names"), F.bool_or(F.coalesce(F.col(name) == wanted, F.lit(False))).alias("has"))


def names_of(df: DataFrame, index: str, names: DataFrame, default: str) -> DataFrame:
    """df with the column name: that of its index in names(index, name), else the default."""
    return df.join(names.select(index, "name"), index, "left").withColumn("name", F.coalesce("name", F.lit(default)))


def sorted_keys(m: Column) -> Column:
    """The keys of a map in order."""
    return F.array_sort(F.map_keys(m))


def invert(m: Column) -> Column:
    """A map with keys and values swapped; of equal values the last entry wins."""
    entries = F.map_entries(m)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["value"] == e["value"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["value"], e["key"])))


def put_one_to_one(m: Column, key: Column, value: Column) -> Column:
    """The map with key -> value, and without entries that had either."""
    return F.map_concat(F.map_filter(m, lambda k, v: (k != key) & (v != value)), F.create_map(key, value))


def latest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The n latest rows: a top-k, as a log keeps."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
