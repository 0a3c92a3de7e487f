"""Incremental translation: grouping, delta, validation, result. Translations come as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions.rows import once
from tallyard.functions.text import squash

#: Languages that a mode asks for: (product ja, product en, option ja, option en).
REQUIREMENTS = {"detail": (True, True, True, False), "general": (True, True, True, True)}
BATCH, WAVE = 100, 10


def group_rows(rows: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, options, problems) of rows productId, nameKo, optionId, optionText, hasOption.

    Problems are errors (empty id, empty name, two names of one id) and options left out
    (empty id, id 0, empty text, other text than the first of that id).
    """
    texts = lambda *names: {c: squash(F.col(c)) for c in names}
    # names and options are read apart, as what a generator makes is made in full wherever it is used
    r = once(rows, [order], texts("productId", "nameKo"))
    first = r.filter("productId <> ''").groupBy("productId").agg(F.min_by("nameKo", order).alias("nameKo"), F.min(order).alias(order), (F.min("nameKo") != F.max("nameKo")).alias("several"))
    fails = first.filter("several").select("productId", F.lit(None).cast("string").alias("optionId"), F.lit("two names").alias("reason"))
    empty = r.filter("productId = '' or nameKo = ''").select("productId", F.lit(None).cast("string").alias("optionId"), F.when(F.col("productId") == "", "empty product id").otherwise("empty name").alias("reason"))
    told = once(rows, [order], {**texts("productId", "optionId", "optionText"), "hasOption": F.coalesce("hasOption", F.lit(False))})
    options = told.filter(F.col("hasOption") | ((F.col("optionId") != "") & (F.col("optionId") != "0") & (F.col("optionText") != "")))
    usable = (F.col("optionId") != "") & (F.col("optionId") != "0") & (F.col("optionText") != "")
    firsts = options.filter(usable).groupBy("productId", "optionId").agg(F.min_by("optionText", order).alias("first"), F.min(order).alias("at"))
    judged = options.join(firsts, ["productId", "optionId"], "left")
    reason = (
        F.when(F.col("optionId") == "", "empty option id").when(F.col("optionId") == "0", "option id 0").when(F.col("optionText") == "", "empty option text")
        .when(F.col("optionText") != F.col("first"), "other text for the same id")
    )
    skipped = judged.select("productId", "optionId", reason.alias("reason")).filter("reason is not null")
    kept = firsts.select("productId", "optionId", F.col("first").alias("ko"), F.col("at").alias(order))
    return first.filter("not several and nameKo <> ''").select("productId", "nameKo", order), kept, fails.unionByName(empty).unionByName(skipped)


def product_delta(products: DataFrame, archive: DataFrame, mode: str) -> DataFrame:
    """Products with the languages their name must be translated to."""
    ja, en, _, _ = REQUIREMENTS[mode]
    stored = archive.select(squash(F.col("id")).alias("productId"), squash(F.col("nameKo")).alias("_ko"), squash(F.col("nameJa")).alias("_ja"), squash(F.col("nameEn")).alias("_en"))
    joined = products.join(stored, "productId", "left")
    same = F.coalesce(F.col("_ko") == F.col("nameKo"), F.lit(False))
    return joined.select(
        *products.columns, (F.lit(ja) & (~same | (F.col("_ja") == ""))).alias("translateNameJa"), (F.lit(en) & (~same | (F.col("_en") == ""))).alias("translateNameEn")
    )


def option_delta(options: DataFrame, archive_options: DataFrame, mode: str) -> DataFrame:
    """Options (productId, optionId, ko) that miss a language."""
    _, _, ja, en = REQUIREMENTS[mode]
    stored = archive_options.select("productId", "optionId", F.col("ko").alias("_ko"), squash(F.col("ja")).alias("_ja"), squash(F.col("en")).alias("_en"))
    joined = options.join(stored, ["productId", "optionId"], "left")
    same = F.coalesce(squash(F.col("_ko")) == F.col("ko"), F.lit(False))
    flags = joined.select(*options.columns, (F.lit(ja) & (~same | (F.col("_ja") == ""))).alias("translateJa"), (F.lit(en) & (~same | (F.col("_en") == ""))).alias("translateEn"))
    return flags.filter("translateJa or translateEn")


def tasks(products: DataFrame, options: DataFrame, archive: DataFrame, archive_options: DataFrame, mode: str, order: str = "ord") -> DataFrame:
    """One row per product with anything to translate, its missing options in order."""
    missing = option_delta(options, archive_options, mode).groupBy("productId").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, "optionId", "ko", "translateJa", "translateEn"))), lambda o: o.dropFields(order)).alias("options")
    )
    need = F.col("translateNameJa") | F.col("translateNameEn")
    joined = product_delta(products, archive, mode).join(missing, "productId", "left").filter(need | F.col("options").isNotNull())
    return joined.select(
        F.col("productId").alias("key"), order, F.when(need, F.col("nameKo")).otherwise("").alias("nameKo"), "translateNameJa", "translateNameEn",
        F.coalesce("options", F.array()).alias("options"),
    )


def batched(tasks_: DataFrame, numbered) -> DataFrame:
    """Adds batch (100 tasks) and wave (10 batches); ``numbered`` gives the dense order."""
    at = F.col("ord") - 1
    return numbered.withColumn("batch", F.floor(at / BATCH)).withColumn("wave", F.floor(at / (BATCH * WAVE)))


def problems(sent: DataFrame, received: DataFrame) -> DataFrame:
    """What is wrong with a response: (key, reason). Both have key, options; received also ja, en."""
    counts = received.groupBy("key").agg(F.count("*").alias("n"))
    twice = counts.filter("n > 1").select("key", F.lit("duplicate key").alias("reason"))
    lost = sent.join(received, "key", "left_anti").select("key", F.lit("missing key").alias("reason"))
    strange = received.join(sent, "key", "left_anti").select("key", F.lit("unknown key").alias("reason"))
    r = received.select("key", F.col("nameJa").alias("_ja"), F.col("nameEn").alias("_en"), F.col("options").alias("_options"))
    both = sent.join(r, "key")
    ids = lambda c: F.array_sort(F.transform(c, lambda o: o["optionId"]))
    reason = (
        F.when(F.col("translateNameJa") & (squash(F.col("_ja")) == ""), "empty ja").when(F.col("translateNameEn") & (squash(F.col("_en")) == ""), "empty en")
        .when(ids("options") != ids("_options"), "other options")
    )
    return twice.unionByName(lost).unionByName(strange).unionByName(both.select("key", reason.alias("reason")).filter("reason is not null"))


def current(products: DataFrame, archive: DataFrame, translated: DataFrame, mode: str) -> DataFrame:
    """Names to use now: a new translation, else the stored one if the Korean name is the same; missing ones marked."""
    ja, en, _, _ = REQUIREMENTS[mode]
    stored = archive.select(squash(F.col("id")).alias("productId"), squash(F.col("nameKo")).alias("_ko"), squash(F.col("nameJa")).alias("_ja"), squash(F.col("nameEn")).alias("_en"))
    new = translated.select("productId", squash(F.col("nameJa")).alias("_nja"), squash(F.col("nameEn")).alias("_nen"))
    joined = products.join(stored, "productId", "left").join(new, "productId", "left")
    pick = lambda n, s: F.coalesce(F.nullif(F.col(n), F.lit("")), F.when(F.col("_ko") == F.col("nameKo"), F.col(s)), F.lit(""))
    out = joined.withColumn("nameJa", pick("_nja", "_ja")).withColumn("nameEn", pick("_nen", "_en"))
    lacking = (F.lit(ja) & (F.col("nameJa") == "")) | (F.lit(en) & (F.col("nameEn") == ""))
    return out.select("productId", "nameKo", "nameJa", "nameEn", lacking.alias("incomplete"))


def wave_counts(tasks_: DataFrame) -> DataFrame:
    return tasks_.groupBy("wave").agg(F.count("*").alias("products"), F.sum(F.size("options")).cast("bigint").alias("options"))


def first_conflict(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Rows whose option text isn't the first of their id."""
    first = F.first_value("optionText").over(Window.partitionBy("productId", "optionId").orderBy(order))
    return rows.withColumn("first", first).filter("optionText <> first")


# --- nested tables ----------------------------------------------------------


def archive_items(archive: DataFrame) -> DataFrame:
    """id, names and options (id, ko, ja, en) of archived products, as the translator reads them."""
    texts = [squash(F.col(c)).alias(c) for c in ("id", "nameKo", "nameJa", "nameEn")]
    option = lambda o: F.struct(squash(o["id"]).alias("id"), squash(o["nameKo"]).alias("ko"), squash(o["nameJa"]).alias("ja"), squash(o["nameEn"]).alias("en"))
    return archive.select(*texts, F.transform(F.coalesce("options", F.array()), option).alias("options"))


def nested(products: DataFrame, options: DataFrame, order: str = "ord") -> DataFrame:
    """``products`` with their options (id, ko) as an array in order."""
    listed = options.groupBy("productId").agg(F.array_sort(F.collect_list(F.struct(order, F.col("optionId").alias("id"), "ko"))).alias("o"))
    joined = products.join(listed, "productId", "left")
    return joined.select(*products.columns, F.coalesce(F.transform("o", lambda o: F.struct(o["id"].alias("id"), o["ko"].alias("ko"))), F.array().cast("array<struct<id:string,ko:string>>")).alias("options"))


def _last(options: Column, option_id: Column) -> Column:
    """The last of ``options`` with an id, or null."""
    same = F.filter(options, lambda o: o["id"] == option_id)
    return F.get(same, F.size(same) - 1)


def with_archive_options(products: DataFrame, items: DataFrame, mode: str) -> DataFrame:
    """In detail mode, products with the options that only the archive has after their own, and its name where they have none.

    ``products`` has productId, nameKo and options (id, ko); ``items`` is what ``archive_items`` gives. Options
    without id or text are left out, and the first of an id counts.
    """
    if mode != "detail":
        return products
    stored = items.select(F.col("id").alias("productId"), F.col("nameKo").alias("stored_name"), F.transform("options", lambda o: F.struct(o["id"].alias("id"), o["ko"].alias("ko"))).alias("stored_options"))
    joined = products.join(stored, "productId", "left")
    filled = F.filter(F.coalesce("stored_options", F.array().cast("array<struct<id:string,ko:string>>")), lambda o: (o["id"] != "") & (o["ko"] != ""))
    known = F.transform("options", lambda o: o["id"])
    fresh = F.filter(filled, lambda o: ~F.coalesce(F.array_contains(known, o["id"]), F.lit(False)))
    first = F.filter(fresh, lambda o, i: F.array_position(F.transform(fresh, lambda x: x["id"]), o["id"]) == i + 1)
    kept = [c for c in products.columns if c not in ("nameKo", "options")]
    name = F.coalesce(F.nullif(squash(F.col("nameKo")), F.lit("")), F.col("stored_name"), F.lit(""))
    return joined.select(*kept, name.alias("nameKo"), F.concat("options", first).alias("options"))


def nested_tasks(products: DataFrame, items: DataFrame, mode: str) -> DataFrame:
    """One row per product with anything to translate; its missing options (id, ko, flags) in the order of its own."""
    name_ja, name_en, option_ja, option_en = REQUIREMENTS[mode]
    stored = items.select(F.col("id").alias("productId"), F.col("nameKo").alias("s_ko"), F.col("nameJa").alias("s_ja"), F.col("nameEn").alias("s_en"), F.col("options").alias("s_options"))
    joined = products.join(stored, "productId", "left")
    lacks = lambda needed, same, text: F.lit(needed) & (~F.coalesce(same, F.lit(False)) | (F.coalesce(text, F.lit("")) == ""))
    same = F.col("s_ko") == F.col("nameKo")
    ja, en = lacks(name_ja, same, F.col("s_ja")), lacks(name_en, same, F.col("s_en"))

    def judged(o: Column) -> Column:
        own = _last(F.col("s_options"), o["id"])
        known = own["ko"] == o["ko"]
        return F.struct(o["id"].alias("id"), o["ko"].alias("ko"), lacks(option_ja, known, own["ja"]).alias("translateJa"), lacks(option_en, known, own["en"]).alias("translateEn"))

    missing = F.filter(F.transform("options", judged), lambda o: o["translateJa"] | o["translateEn"])
    rest = [c for c in products.columns if c not in ("productId", "nameKo", "options")]
    flagged = joined.select(F.col("productId").alias("key"), *rest, "nameKo", ja.alias("translateNameJa"), en.alias("translateNameEn"), missing.alias("options"))
    need = F.col("translateNameJa") | F.col("translateNameEn")
    return flagged.filter(need | (F.size("options") > 0)).withColumn("nameKo", F.when(need, F.col("nameKo")).otherwise(""))
