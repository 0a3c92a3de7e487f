"""Exchange rates: derivation, history, conversion."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.functions.rows import bound, once
from tallyard.functions.text import kst_minute, round_half_up

CURRENCY, UNIT = "JPY", 100


def assigned_json(page: str | None, name: str = "_data") -> str | None:
    """The object that a page assigns to ``name``: braces are balanced, strings are skipped."""
    at = (page or "").find(f"{name} =")
    begin = page.find("{", at) if at >= 0 else -1
    depth, quote, i = 0, "", begin
    while 0 <= i < len(page or ""):
        ch = page[i]
        if quote:
            if ch == "\\":
                i += 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'":
            quote = ch
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if not depth:
                return page[begin : i + 1]
        i += 1
    return None


def assigned(text: Column, name: str = "_data") -> Column:
    """(json, error) of the object that a script assigns to ``name``: from its brace to the one that closes it.

    Pairs of a backslash and a character are covered first, then strings can be skipped as a whole;
    the text is cut after each brace and string, and the object is what it takes for the depth to be 0 again.
    """
    step = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("ends"))

    def take(state: Column, cut: Column) -> Column:
        last = F.when(~cut.contains('"'), F.right(cut, F.lit(1))).otherwise("")  # a string that doesn't end may end in a brace
        depth = state["depth"] + F.when(last == "{", 1).when(last == "}", -1).otherwise(0)
        return F.when(state["ends"], state).otherwise(F.struct(depth.alias("depth"), (state["length"] + F.length(cut)).alias("length"), ((depth == 0) & (last == "}")).alias("ends")))

    def closed(rest: Column) -> Column:
        covered = F.regexp_replace(rest, r"(?s)\\.", "__")
        cuts = F.regexp_extract_all(covered, F.lit(r'[^"{}]*+(?:"[^"]*+"?|[{}])'), F.lit(0))
        return bound(F.aggregate(cuts, step, take), lambda end: F.struct((rest == "").alias("none"), end["ends"].alias("ends"), F.substring(rest, F.lit(1), end["length"]).alias("json")))

    def judged(found: Column) -> Column:
        error = F.when(text.isNull() | ~text.rlike(rf"\b{name}\s*="), "no assignment").when(found["none"], "no object").when(~found["ends"], "incomplete")
        return F.struct(F.when(~found["none"] & found["ends"], found["json"]).alias("json"), error.alias("error"))

    from_brace = lambda said: F.when(said.contains("{"), F.substring(said, F.locate("{", said), F.length(said))).otherwise("")
    return bound(bound(bound(F.regexp_extract(text, rf"(?s)\b{name}\s*=\s*(.*)$", 1), from_brace), closed), judged)


def page_rates(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of ``pages`` and currency, unit, cashBuy of each entry of the rate list."""
    kept = [c for c in pages.columns if c != html]
    entry = "struct<rates:array<struct<currency:string,unit:double,cashBuy:double>>>"
    return pages.select(*kept, F.explode(F.from_json(assigned(F.col(html))["json"], entry)["rates"]).alias("_r")).select(*kept, "_r.*")


def script_rates(pages: DataFrame, html: str = "html", currency: str = CURRENCY) -> DataFrame:
    """The other columns of ``pages``, currency, unit, cashBuy, day and error of the rate that its script lists for ``currency``.

    Numbers may be texts with commas. ``derive`` judges unit and rate.
    """
    kept = [c for c in pages.columns if c != html]
    found = once(pages, kept, {"a": assigned(F.col(html))})
    found = once(found, kept, {"error": F.col("a.error"), "v": F.try_parse_json("a.json")})
    rates = F.coalesce(F.try_variant_get("v", "$.REC_FXD", "array<variant>"), F.array().cast("array<variant>"))
    own = F.get(F.filter(rates, lambda r: F.try_variant_get(r, "$.CURR_CODE", "string") == currency), F.lit(0))
    number = lambda name: F.replace(F.try_variant_get("r", f"$.{name}", "string"), F.lit(","), F.lit("")).try_cast("double")
    rows = once(found, [*kept, "error", "v"], {"r": own})
    error = F.coalesce("error", F.when(F.col("v").isNull(), "no JSON").when(F.col("r").isNull(), "no rate"))
    return once(rows, kept, {
        "currency": F.try_variant_get("r", "$.CURR_CODE", "string"), "unit": number("UNIT_PRICE"), "cashBuy": number("CASH_BUY"), "day": F.trim(F.try_variant_get("r", "$.EXCHANGE_DATE", "string")), "error": error,
    })


def derived_rates(pages: DataFrame, html: str = "html") -> DataFrame:
    """``script_rates`` with rate and revRate, and the first thing that is wrong."""
    found = script_rates(pages, html).withColumnRenamed("error", "reading")
    return derive(found).withColumn("error", F.coalesce("reading", "error")).drop("reading")


def derive(rates: DataFrame) -> DataFrame:
    """Adds rate (units of yen for a won, 5 places), revRate (2 places) and error."""
    error = F.when((F.col("currency") != CURRENCY) | F.col("currency").isNull(), "other currency").when(F.col("unit") != UNIT, "unit").when(
        ~(F.col("cashBuy") > 0) | F.col("cashBuy").isNull(), "rate"
    )
    buy = F.col("cashBuy").cast("decimal(18,6)")
    ok = error.isNull()
    return (
        rates.withColumn("rate", F.when(ok, F.round(F.lit(UNIT).cast("decimal(18,6)") / buy, 5)).cast("decimal(12,5)"))
        .withColumn("revRate", F.when(ok, F.round(buy, 2)).cast("decimal(12,2)")).withColumn("error", error)
    )


def update_history(history: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """One row per date: the last one given, new ones replacing old."""
    both = history.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in history.columns if c not in ("date", order)]
    return both.groupBy("date").agg(*[F.max_by(c, F.struct("_new", order)).alias(c) for c in rest])


def stored_history(documents: DataFrame, column: str = "json") -> DataFrame:
    """date, rate, revRate and ord of each entry of history documents; blank ones are empty, any that is no list fails the job."""
    text = F.regexp_replace(F.col(column), "^\ufeff", "")
    parsed = F.try_parse_json(F.when(F.trim(text) == "", "[]").otherwise(text))
    entries = F.try_variant_get(parsed, "$", "array<struct<date:string,rate:double,revRate:double>>")
    rows = documents.select(F.posexplode(F.coalesce(entries, F.raise_error(F.lit("a rate history must be a list")))).alias("ord", "e"))
    return rows.select("e.date", "e.rate", "e.revRate", "ord")


def history_document(history: DataFrame) -> DataFrame:
    """One column ``json``, the history as one indented list by date; it has one entry per day."""
    entries = F.array_sort(F.collect_list(F.struct(F.coalesce("date", F.lit("")).alias("date"), "rate", "revRate")))
    return history.agg(F.to_json(entries, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def hourly(rates: DataFrame, ts: str = "ts", order: list[str] | None = None) -> DataFrame:
    """The last row of each hour, by ``order`` (``ts`` alone if not given)."""
    hour, last = F.date_trunc("HOUR", F.col(ts)), F.struct(*(order or [ts]))
    return rates.groupBy(hour.alias("hour")).agg(*[F.max_by(c, last).alias(c) for c in rates.columns if c != ts])


def to_yen(price: Column, rate: Column) -> Column:
    """Rounded half up; null stays null, negative prices give null (see ``price_errors``)."""
    return F.when(price >= 0, round_half_up(price * rate)).cast("bigint")


def convert(products: DataFrame, rates: DataFrame, at: Column, price: str = "price") -> DataFrame:
    """Prices by the one-row table ``rates``, stamped with the minute."""
    return products.crossJoin(F.broadcast(rates.select("rate").limit(1))).withColumn("yenPrice", to_yen(F.col(price), F.col("rate"))).withColumn("convertTime", kst_minute(at))


def convert_dated(products: DataFrame, history: DataFrame, price: str = "price") -> DataFrame:
    """Prices by the rate of their own date."""
    return products.join(history.select("date", "rate"), "date", "left").withColumn("yenPrice", to_yen(F.col(price), F.col("rate").cast("double")))


def price_errors(products: DataFrame, price: str = "price") -> DataFrame:
    return products.filter(F.col(price) < 0).withColumn("error", F.lit("negative price"))


def parse_rates_text(text: str) -> list[dict]:
    """For small files: the rate list of one page."""
    found = assigned_json(text)
    return json.loads(found).get("rates", []) if found else []
