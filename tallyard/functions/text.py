"""Column functions for names, numbers, booleans, urls, dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the white space that names are squeezed by
SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
#: Runs of white space but for one blank ahead of a visible ASCII character, which stays as it is: most places are passed by one comparison.
RUNS = f"(?=[^!-~])(?! [!-~]){SPACE}"
TRUE_WORDS = ("true", "1", "yes", "y", "on", "show")
FALSE_WORDS = ("false", "0", "no", "n", "off", "hide")


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}", ""), f"{SPACE}$", "")


def squash(c: Column) -> Column:
    """White space runs to one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), RUNS, " "))


def has_text(c: Column) -> Column:
    return squash(c) != ""


def has_items(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def first_text(*columns: Column) -> Column:
    """First of the columns that isn't null or empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def first_positive(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c > 0, c) for c in columns])


def to_number(c: Column) -> Column:
    """Whole number of the digits and signs of a text; 0 if they are none."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9-]", "")
    return F.coalesce(kept.try_cast("bigint"), F.lit(0).cast("bigint"))


def to_nullable_number(c: Column) -> Column:
    """Null and empty are null, blank is 0, text that is no number is null."""
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("double")).when(strip(c) == "", F.lit(0.0)).otherwise(strip(c).try_cast("double"))


def to_price(c: Column) -> Column:
    """First decimal number of a text without its commas, or null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, ",", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("decimal(18,4)")


def parse_price(c: Column) -> Column:
    """First whole number of a text, commas allowed; 0 if there is none."""
    return to_number(F.regexp_extract(F.coalesce(c, F.lit("")), r"-?[0-9][0-9,]*", 0))


def to_boolean(c: Column, fallback: Column) -> Column:
    word = F.lower(strip(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(fallback)


def to_integer(c: Column, fallback: int, least: int = 0) -> Column:
    value = c.try_cast("double")
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("bigint")
    return F.when(whole.isNull(), F.lit(fallback).cast("bigint")).otherwise(F.greatest(whole, F.lit(least).cast("bigint")))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def format_ms(ms: Column) -> Column:
    """``999ms``, ``1.50s``, ``1m 1.5s``."""
    seconds = ms / 1000
    minutes = F.floor(seconds / 60).cast("int")
    return (
        F.when(ms < 1000, F.format_string("%dms", ms.cast("bigint")))
        .when(seconds < 60, F.format_string("%.2fs", seconds))
        .otherwise(F.format_string("%dm %.1fs", minutes, seconds - minutes * 60))
    )


def display_number(c: Column) -> Column:
    """Thousands apart, three places at most; a dash for null."""
    return F.coalesce(F.call_function("format_number", c, F.lit("#,##0.###")), F.lit("-"))


def product_name(c: Column) -> Column:
    # fixed value: the link text that listings append to names
    return strip(F.regexp_replace(squash(c), "\\s*바로가기\\s*$", ""))


def comparable_name(c: Column) -> Column:
    """Without bracketed parts and white space, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(squash(c), r"\[[^\]]*\]", ""), SPACE, ""))


def query_value(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def page_number(url: Column) -> Column:
    return query_value(url, "page").try_cast("int")


def same_list_url(a: Column, b: Column, names: tuple[str, ...] = ("page", "cate", "sort")) -> Column:
    """Host without www., path and the parameters that define a list agree."""
    host = lambda u: F.regexp_replace(F.try_parse_url(u, F.lit("HOST")), "^www\\.", "")
    out = host(a).eqNullSafe(host(b)) & F.try_parse_url(a, F.lit("PATH")).eqNullSafe(F.try_parse_url(b, F.lit("PATH")))
    for n in names:
        out = out & F.coalesce(query_value(a, n), F.lit("")).eqNullSafe(F.coalesce(query_value(b, n), F.lit("")))
    return out


def absolute_url(url: Column, scheme: str, host: str, folder: str = "/") -> Column:
    """Resolved against scheme://host + folder; empty and data: urls are empty."""
    u = strip(F.coalesce(url, F.lit("")))
    base = f"{scheme}://{host}"
    path = (
        F.when((u == "") | F.lower(u).startswith("data:"), "")
        .when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u)
        .when(u.startswith("//"), F.concat(F.lit(f"{scheme}:"), u))
        .when(u.startswith("/"), F.concat(F.lit(base), u))
        .when(u.startswith("?") | u.startswith("#"), F.concat(F.lit(base + folder), u))
        .otherwise(F.concat(F.lit(base + folder), F.regexp_replace(u, r"^(?:\./)+", "")))
    )
    # steps up are taken one by one, never above the root
    head, tail = F.regexp_extract(path, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0), F.regexp_extract(path, r"(?s)[?#].*$", 0)
    steps = F.substring(path, F.length(head) + 1, F.length(path) - F.length(head) - F.length(tail))

    def take(done: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))

    walked = F.array_join(F.aggregate(F.split(steps, "/"), F.array().cast("array<string>"), take), "/")
    return F.when(steps.contains("/../"), F.concat(head, walked, tail)).otherwise(path)


def outer_box_quantity(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)([0-9]+)\s*EA", 1), F.lit("")).try_cast("int")


def barcode_after_number(c: Column) -> Column:
    """13 digits that follow a bracketed product number and aren't followed by a digit."""
    return F.nullif(F.regexp_extract(c, r"상품번호\s*\[\s*[0-9]+\s*\]\s*([0-9]{13})(?![0-9])", 1), F.lit(""))


def ids_in_message(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"상품\s*([0-9]{3,})"), F.lit(1))


def coverage_key(product: Column, option: Column, has_option: Column) -> Column:
    return F.concat_ws("::", squash(product), F.when(has_option, squash(option)).otherwise(F.lit("0")))


def kst(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "Asia/Seoul")


def kst_minute(ts: Column) -> Column:
    return F.date_format(kst(ts), "yyMMddHHmm")


def kst_date(ts: Column) -> Column:
    return F.date_format(kst(ts), "yyMMdd")


def kst_day(ts: Column) -> Column:
    return F.date_format(kst(ts), "yyyy-MM-dd")


def year_start(day: Column) -> Column:
    """The day a year earlier; 29 February goes to 1 March."""
    before = F.add_months(day, -12)
    leap = (F.month(day) == 2) & (F.dayofmonth(day) == 29)
    return F.when(leap, F.date_add(before, 1)).otherwise(before)


def next_hour(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts) + F.expr("INTERVAL 1 HOUR")


def ms_to_next_hour(ts: Column) -> Column:
    return F.unix_millis(next_hour(ts)) - F.unix_millis(ts)


def next_daily_run(now: Column, hour: int, minute: int) -> Column:
    """The next time of day ``hour:minute`` after ``now``."""
    today = F.date_trunc("DAY", now) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    return F.when(today > now, today).otherwise(today + F.expr("INTERVAL 1 DAY"))


def progress_percent(done: Column, total: Column, low: int = 5, high: int = 98) -> Column:
    share = F.when(total > 0, F.floor(done * 100 / total)).otherwise(F.lit(low))
    return F.least(F.greatest(share, F.lit(low)), F.lit(high)).cast("int")


def page_range_text(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.format_string("%d~%d", first, last))


def retry_delay(attempt: Column, base_ms: int, cap_ms: int, jitter: Column) -> Column:
    """Doubling delay with a cap, times 0.85 to 1.15 for ``jitter`` in 0..1."""
    return F.floor(F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(cap_ms))) * (F.lit(0.85) + F.lit(0.3) * jitter) + 0.5)


def not_thumbnail(url: Column) -> Column:
    return ~url.rlike("(?i)/thumb/")


def distinct_texts(items: Column) -> Column:
    """Squeezed texts of an array without empty ones, the first of each kept in place."""
    return F.array_distinct(F.filter(F.transform(items, squash), lambda x: x != ""))


def pick_by_words(entries: Column, words: list[str]) -> Column:
    """Value of the first entry (key, value) whose key holds the first word that any key holds."""
    def first(word: str) -> Column:
        return F.get(F.filter(entries, lambda e: e["key"].contains(word)), F.lit(0))

    return F.coalesce(*[first(w) for w in words])["value"]


def strict_json(c: Column) -> Column:
    """The value of a text that is JSON from end to end, else null.

    The parser leaves out what follows a value; between brackets and ahead of a mark, nothing may.
    """
    around = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"end"]'))), "$", "array<variant>")
    whole = (F.size(around) == 2) & (F.try_variant_get(F.get(around, F.lit(1)), "$", "string") == "end")
    return F.when(whole, F.get(around, F.lit(0)))


def parsed_object(c: Column) -> Column:
    """Entries of a JSON object in a text, as texts of their values; empty for anything else."""
    v = strict_json(c)
    entries = F.try_variant_get(v, "$", "map<string,string>")
    return F.coalesce(F.when(F.schema_of_variant(v).startswith("OBJECT"), entries), F.create_map().cast("map<string,string>"))


def response_value(c: Column) -> Column:
    """(json, text) of a response: its JSON where it is some, else the text; neither where it is empty."""
    json = strict_json(c)
    return F.struct(F.to_json(json).alias("json"), F.when(json.isNull(), F.nullif(c, F.lit(""))).alias("text"))


def json_key(c: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(strip(c.cast("string")), F.lit("")), F.lit(fallback))
