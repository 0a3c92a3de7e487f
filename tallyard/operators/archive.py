"""The product archive: an upsert with rules for each field, source and kind of emptiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyard.functions.schemas import DETAIL_FIELDS, GENERAL_FIELDS, OPTION, PRODUCT
from tallyard.functions.text import has_items, has_text, round_half_up, squash
from tallyard.sources import buckets

NAMES = ("nameKo", "nameJa", "nameEn")
#: Fields that only text may overwrite, for the source that reads lists.
GENERAL_TEXT = ("nameKo", "nameJa", "nameEn", "saleStatus", "stockStatus", "type")
ARRAYS = ("imageUrls", "specs")
STOCK_FIELDS = ("type", "stockQuantity", "stockStatus", "saleStatus")
OPTION_FIELDS = ("id", "barcode", "name", "nameKo", "nameJa", "nameEn", "additionalPrice", "stockQuantity", "status")
OPTION_GENERAL = ("barcode", "name", "nameKo", "nameJa", "nameEn", "stockQuantity", "status")
OPTION_DETAIL = ("name", "nameKo", "nameJa", "nameEn", "additionalPrice", "barcode")


def normalise(products: DataFrame, archived: bool = False) -> DataFrame:
    """All product fields with their types; unknown columns go, missing ones are null or, in an archive, the default."""
    out = []
    for name, (kind, default) in PRODUCT.items():
        if name in products.columns:
            value = F.col(name).cast(kind)
            out.append((F.coalesce(value, F.expr(default).cast(kind)) if archived else value).alias(name))
        else:
            out.append((F.expr(default) if archived else F.lit(None)).cast(kind).alias(name))
    flags = [F.col(c).cast("boolean").alias(c) if c in products.columns else F.lit(False).alias(c) for c in ("inventoryObserved", "inventoryUnavailable")]
    return products.select(*out) if archived else products.select(*out, *flags)


def option_key(option: Column, position: Column) -> Column:
    return F.when(has_text(option["id"]), squash(option["id"])).otherwise(F.concat(F.lit("__missing_option_"), (position + 1).cast("string")))


def _options_map(options: Column) -> Column:
    """Options by key, the last of a key winning at the first's place."""
    keyed = F.transform(F.coalesce(options, F.array().cast(f"array<{OPTION}>")), lambda o, i: F.struct(option_key(o, i).alias("key"), o.alias("value")))
    keys = F.array_distinct(F.transform(keyed, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(keyed, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def _merged_option(key: Column, old: Column, new: Column, source: str) -> Column:
    """One option after the merge, with ``isNew`` and the number of changed fields."""
    base = {f: F.coalesce(old[f], F.lit("" if f not in ("additionalPrice", "stockQuantity", "barcode") else None)) for f in OPTION_FIELDS}
    base["additionalPrice"] = F.when(old.isNull(), F.lit(0).cast("bigint")).otherwise(old["additionalPrice"])
    base["status"] = F.when(old.isNull(), F.lit("")).otherwise(old["status"])
    incoming = {f: new[f] for f in OPTION_FIELDS}
    incoming["name"] = F.coalesce(F.nullif(squash(new["name"]), F.lit("")), F.nullif(squash(new["nameJa"]), F.lit("")))
    out = dict(base)
    if source == "translation":
        changed = has_text(new["nameKo"]) & (squash(base["nameKo"]) != squash(new["nameKo"]))
        for f in NAMES:
            only = F.when(has_text(new[f]), squash(new[f])).otherwise(base[f]) if f != "nameKo" else base[f]
            out[f] = F.when(changed, squash(new[f])).otherwise(only)
        out["name"] = F.when(changed | has_text(new["nameJa"]), squash(new["nameJa"])).otherwise(base["name"])
    else:
        for f in OPTION_GENERAL if source == "general" else OPTION_DETAIL:
            if f in ("stockQuantity",):
                out[f] = incoming[f]
            elif f == "additionalPrice":
                out[f] = F.coalesce(incoming[f], base[f])
            else:
                out[f] = F.when(has_text(incoming[f]), incoming[f]).otherwise(base[f])
    out["id"] = F.coalesce(F.nullif(squash(new["id"]), F.lit("")), key)
    changes = sum((~out[f].eqNullSafe(base[f])).cast("int") for f in OPTION_FIELDS if f != "id")
    kept = F.struct(*[F.when(new.isNull(), old[f]).otherwise(out[f]).alias(f) for f in OPTION_FIELDS])
    return F.struct(
        kept.cast(OPTION).alias("option"), (new.isNotNull() & old.isNull()).alias("isNew"), F.when(new.isNull(), 0).otherwise(changes).alias("changes"),
    )


def _ordered(entries: Column) -> Column:
    """Entries (key, value) as an object lists them: whole numbers first, by value, then the rest as they came."""
    ranked = F.transform(entries, lambda e, i: F.struct(F.when(e["key"].rlike("^(0|[1-9][0-9]{0,8})$"), 0).otherwise(1).alias("kind"),
                                                        F.when(e["key"].rlike("^(0|[1-9][0-9]{0,8})$"), e["key"].cast("bigint")).otherwise(i.cast("bigint")).alias("at"), i.alias("i")))
    return F.transform(F.array_sort(ranked), lambda r: F.get(entries, r["i"]))


def merge(stored: DataFrame, incoming: DataFrame, source: str, rate: float | None = None, convert_time: str | None = None) -> DataFrame:
    """The merged archive: all product fields plus ``state`` (new, updated, unchanged, kept), ``changedFields``,
    ``newOptions`` and ``updatedOptions``. Ids of ``incoming`` must be unique and non-empty."""
    if source not in ("general", "detail", "translation"):
        raise ValueError(f"unknown source {source}")
    if (rate is None) != (convert_time is None) or (rate is not None and (not rate > 0 or not convert_time.isdigit() or len(convert_time) != 10)):
        raise ValueError("a conversion needs a positive rate and a time of ten digits")
    old = normalise(stored, archived=True).select(F.struct("*").alias("old"), F.col("id").alias("_id"))
    new = normalise(incoming).filter(has_text(F.col("id"))).select(F.struct("*").alias("new"), squash(F.col("id")).alias("_id"))
    both = old.join(new, "_id", "full")
    present, fresh = F.col("new").isNotNull(), F.col("old").isNull()
    base = {f: F.when(fresh, F.lit(None).cast(k) if f == "id" else F.expr(d).cast(k)).otherwise(F.col("old")[f]) for f, (k, d) in PRODUCT.items()}
    both = both.withColumn("base", F.struct(*[c.alias(f) for f, c in base.items()]))
    b, n = (lambda f: F.col("base")[f]), (lambda f: F.col("new")[f])
    out = {f: b(f) for f in PRODUCT}
    out["id"] = F.col("_id")
    if source == "translation":
        renamed = has_text(n("nameKo")) & (squash(b("nameKo")) != squash(n("nameKo")))
        out["nameKo"] = F.when(renamed, squash(n("nameKo"))).otherwise(b("nameKo"))
        for f in ("nameJa", "nameEn"):
            out[f] = F.when(renamed | has_text(n(f)), squash(n(f))).otherwise(b(f))
    elif source == "general":
        idle = ~F.coalesce(n("inventoryObserved"), F.lit(False)) & ~F.coalesce(n("inventoryUnavailable"), F.lit(False))
        for f in GENERAL_FIELDS:
            new_value = F.when(has_text(n(f)), n(f)).otherwise(b(f)) if f in GENERAL_TEXT else n(f)
            if f == "lowStockThreshold":
                new_value = F.coalesce(n(f), b(f))
            out[f] = F.when(idle, b(f)).otherwise(new_value) if f in STOCK_FIELDS else new_value
    else:
        for f in DETAIL_FIELDS:
            if f in ARRAYS:
                value = F.filter(n(f), lambda u: ~u.rlike("(?i)/thumb/")) if f == "imageUrls" else n(f)
                out[f] = F.when(has_items(value), value).otherwise(b(f))
            elif f == "subcategoryId":
                out[f] = F.coalesce(n(f), b(f))
            else:
                out[f] = F.when(has_text(n(f)), n(f)).otherwise(b(f))
    olds, news = _options_map(b("options")), _options_map(n("options"))
    merged = F.map_zip_with(olds, news, lambda k, o, v: _merged_option(k, o, v, source))
    both = both.withColumn("merged", merged)
    cleared = F.lit(False)
    if source == "general":
        cleared = F.coalesce(n("inventoryObserved"), F.lit(False)) & (n("type") == "SINGLE") & ~has_items(n("options")) & has_items(b("options"))
    entries = F.map_entries("merged")
    options = F.transform(_ordered(entries), lambda e: e["value"]["option"])
    out["options"] = F.when(cleared, F.array().cast(f"array<{OPTION}>")).otherwise(options)
    out["type"] = F.when(F.size(out["options"]) > 0, "OPTION").otherwise(F.coalesce(F.nullif(out["type"], F.lit("")), F.lit("SINGLE")))
    if rate is not None:
        price = out["originalPrice"]
        out["yenPrice"] = F.when(price >= 0, round_half_up(price.cast("double") * rate)).cast("bigint")
        out["convertTime"] = F.lit(convert_time)
    # kept products list their options in the order of an object's keys too
    final = F.struct(*[F.when(present, c).otherwise(options if f == "options" else b(f)).alias(f) for f, c in out.items()])
    both = both.withColumn("final", final)
    scalars = [f for f in PRODUCT if f not in ("id", "options")]
    changes = sum((~F.col("final")[f].eqNullSafe(b(f))).cast("int") for f in scalars) + cleared.cast("int")
    values = F.map_values("merged")
    count = lambda test: F.when(cleared, 0).otherwise(F.size(F.filter(values, test)))
    inside = F.when(cleared, 0).otherwise(F.aggregate(values, F.lit(0), lambda a, v: a + v["changes"]))
    both = both.select(
        "final.*", F.when(present, changes + inside).otherwise(0).alias("changedFields"),
        F.when(present, count(lambda v: v["isNew"])).otherwise(0).alias("newOptions"),
        F.when(present, count(lambda v: ~v["isNew"] & (v["changes"] > 0))).otherwise(0).alias("updatedOptions"),
        present.alias("_present"), fresh.alias("_fresh"),
    )
    state = (
        F.when(~F.col("_present"), "kept").when(F.col("_fresh"), "new")
        .when((F.col("changedFields") > 0) | (F.col("newOptions") > 0), "updated").otherwise("unchanged")
    )
    return both.withColumn("state", state).drop("_present", "_fresh")


def statistics(merged: DataFrame) -> DataFrame:
    """One row of numbers about a merge."""
    return merged.agg(
        *[F.count_if(F.col("state") == s).alias(f"{s}Count") for s in ("new", "updated", "unchanged", "kept")],
        F.sum("changedFields").cast("bigint").alias("changedFieldCount"), F.sum("newOptions").cast("bigint").alias("newOptionCount"),
        F.sum("updatedOptions").cast("bigint").alias("updatedOptionCount"),
    )


# --- snapshots --------------------------------------------------------------


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot below ``path``, or an empty archive."""
    schema = ", ".join(f"`{f}` {k}" for f, (k, _) in PRODUCT.items())
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return spark.createDataFrame([], schema)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("version="))
    done = [v for v in versions if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{v}/_SUCCESS"))]
    return spark.read.schema(schema).parquet(f"{path}/{done[-1]}") if done else spark.createDataFrame([], schema)


def write_snapshot(products: DataFrame, path: str, version: int) -> None:
    """A whole new version beside the old ones; readers take the newest that is complete."""
    products.select(*PRODUCT).write.mode("errorifexists").parquet(f"{path}/version={version:012d}")


# --- buckets ----------------------------------------------------------------

SCHEMA = ", ".join(f"`{f}` {k}" for f, (k, _) in PRODUCT.items())


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The archive that ``update_buckets`` keeps below ``path``; empty before the first update."""
    return buckets.read(spark, path, SCHEMA)


def update_buckets(
    incoming: DataFrame, path: str, source: str, rate: float | None = None, convert_time: str | None = None, version: int | None = None, count: int = buckets.BUCKETS,
) -> DataFrame | None:
    """Merges ``incoming`` into the archive below ``path``: only buckets that hold a new or an updated product are written.

    Returns the merge of the buckets that ``incoming`` touches, as ``merge`` does, or None if
    ``version`` was applied before.
    """
    new = normalise(incoming).filter(has_text(F.col("id"))).withColumn("id", squash(F.col("id")))
    changed = F.col("state").isin("new", "updated") | (F.lit(rate is not None) & (F.col("state") != "kept"))
    return buckets.update(path, new, "id", lambda stored, own: merge(stored, own, source, rate, convert_time), SCHEMA, version, count, changed)
