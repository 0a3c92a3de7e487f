"""First-wins, last-wins, and uniqueness reports. All need an order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.sources.shared import frozen


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. One pre-aggregated shuffle: no sort of a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def last_value_first_position(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, standing where the first stood."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"), F.min(order).alias(order))
    return out.select(*[c if c in (*keys, order) else F.col(f"_row.{c}").alias(c) for c in df.columns])


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores after it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _quoted(names: list[str]) -> list[Column]:
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def running_total(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to each row among the rows of its key, in ``order``.

    Rows are sorted by range, and ranges are written once, so that sums and offsets are of the same
    ones. Sums run within a range and key; what the ranges before hold of a key is one row for each of
    them. So neither a key with most of the rows nor no key at all puts its rows into one task.
    """
    part, at, own, local, before = (unused(x, df.columns) for x in ("part", "at", "own", "local", "before"))
    sorted_ = df.withColumn(own, value)
    sorted_ = sorted_.repartitionByRange(*_quoted(keys), *order).sortWithinPartitions(*_quoted(keys), *order)
    spread = frozen(sorted_.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "ranges")
    within = Window.partitionBy(part, *_quoted(keys)).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    sums = spread.groupBy(part, *_quoted(keys)).agg(F.sum(own).alias(own))
    earlier = Window.partitionBy(*_quoted(keys)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(part, *_quoted(keys), F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias(before)).filter(F.col(before) > 0)
    # null keys are keys like others
    same = [F.col(f"l.{part}") == F.col(f"o.{part}"), *[F.col(f"l.`{k}`").eqNullSafe(F.col(f"o.`{k}`")) for k in keys]]
    # a range's end parts one key from itself at most: offsets are as many as ranges
    summed = spread.withColumn(local, F.sum(own).over(within)).alias("l").join(F.broadcast(offsets).alias("o"), same, "left")
    rest = [F.col(f"l.`{c.replace('`', '``')}`") for c in df.columns if c != name]
    return summed.select(*rest, (F.col(f"l.{local}") + F.coalesce(F.col(f"o.{before}"), F.lit(0))).alias(name))


def numbered(df: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """A dense number over the whole frame, without a window over all rows."""
    return running_total(df, [], order, F.lit(1).cast("long"), name)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on several rows or are empty, with the reason."""
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull() | (F.col(k).cast("string") == "")
    found = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("reason", F.when(empty, "empty").when(F.col("n") > 1, "duplicate"))
    return found.filter("reason is not null")


def first_n(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; 0 is no limit."""
    if n <= 0:
        return df
    rank = unused("rank", df.columns)
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*_quoted(group)).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n).drop(rank)


def suffixed(df: DataFrame, group: list[str], name: str, order: list[str], out: str) -> DataFrame:
    """Names made unique in their group: ``name``, ``name_2``, ``name_3``, ...

    The first row of a name keeps it. The others take the numbers from 2 on, in order, but none
    that makes a name that some row of the group has already; so all names differ, whatever they are.
    A null name counts as empty.
    """
    df = df.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit("")))
    rank, base, number = (unused(x, df.columns) for x in ("rank", "base", "number"))
    ranked = frozen(running_total(df, [*group, name], order, F.lit(1).cast("long"), rank), "ranked")
    literal = ranked.select(*_quoted(group), F.col(name).alias("literal")).distinct()
    split = literal.select(
        *_quoted(group), F.regexp_extract("literal", r"(?s)^(.*)_([1-9][0-9]{0,17})$", 1).alias(base), F.regexp_extract("literal", r"(?s)^(.*)_([1-9][0-9]{0,17})$", 2).try_cast("long").alias(number),
    )
    same = lambda a, b: [*[F.col(f"{a}.`{g}`").eqNullSafe(F.col(f"{b}.`{g}`")) for g in group], F.col(f"{a}.`{name}`") == F.col(f"{b}.{base}")]
    repeated = ranked.filter(F.col(rank) > 1)
    taken = frozen(split.filter(F.col(number) > 1).alias("t").join(repeated.alias("r"), same("r", "t"), "left_semi"), "taken")
    # the i-th taken number (from 0) moves all ranks from number - i on up by one
    counted = running_total(taken, [*group, base], [number], F.lit(1).cast("long"), rank)
    moves = counted.select(*_quoted(group), F.col(base).alias(name), (F.col(number) - F.col(rank) + 1).alias(rank), F.lit(1).cast("long").alias(number))
    hit = repeated.alias("r").join(taken.select(*_quoted(group), base).distinct().alias("t"), same("r", "t"), "left_semi").select("r.*")
    rest = [c for c in df.columns if c not in (*group, name)]
    rows = hit.select(*_quoted(group), name, rank, F.lit(0).cast("long").alias(number), F.struct(*_quoted(rest) or [F.lit(1)]).alias(base))
    both = rows.unionByName(moves.withColumn(base, F.lit(None).cast(rows.schema[base].dataType)))
    shifted = running_total(both, [*group, name], [F.col(rank), F.col(number).desc()], F.col(number), "shift").filter(F.col(number) == 0)
    named = lambda frame, n: frame.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), n.cast("string"))))
    plain = ranked.alias("r").join(taken.select(*_quoted(group), base).distinct().alias("t"), same("r", "t"), "left_anti").select("r.*")
    first = ranked.filter(F.col(rank) == 1).alias("r").join(taken.select(*_quoted(group), base).distinct().alias("t"), same("r", "t"), "left_semi").select("r.*")
    moved = shifted.select(*_quoted(group), name, *[F.col(f"{base}.`{c}`") for c in rest], (F.col(rank) + F.col("shift")).alias(rank))
    columns = [c for c in df.columns if c != out]
    parts = [named(frame, F.col(rank)).select(*_quoted(columns), out) for frame in (plain, first, moved)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def by_name(df: DataFrame, group: list[str], names: list[Column], order: list[str], value: Column) -> DataFrame:
    """(group, entries): the rows of each group as a map from unique names to ``value``; rows without any of ``names`` are ``option_<n>``.

    For groups of a bounded size, such as the options of a product.
    """
    text, place, own, out = (unused(x, df.columns) for x in ("text", "place", "own", "unique"))
    listed = running_total(df.withColumn(own, value), group, order, F.lit(1).cast("long"), place)
    given = F.trim(F.coalesce(*[F.when(n != "", n) for n in names], F.lit("default")))
    base = listed.withColumn(text, F.when(given != "", given).otherwise(F.concat(F.lit("option_"), F.col(place).cast("string"))))
    unique = suffixed(base.select(*_quoted(group), text, place, own), group, text, [place], out)
    return unique.groupBy(*_quoted(group)).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(place, out, own))), lambda x: F.struct(x[out], x[own]))).alias("entries"))
