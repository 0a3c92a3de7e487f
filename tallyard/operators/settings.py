"""Settings of runs: what a request names, else what is stored, else the default; and the part that may be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.functions.text import has_text, query_value, strip, to_boolean, to_integer

# fixed values
#: Parameter of a list url that names the category, default category, default size of a page.
MALLS = {"mall-a": ("cateIDX", "-1", 150), "mall-b": ("cateCd", "017", 40)}
#: Default and least value of whole numbers that only a request may set.
ASKED = {
    "pageStart": (1, 1), "pageEnd": (0, 0), "maxPerPage": (150, 1), "cartQty": (999, 1), "lowStockThreshold": (10, 0), "requestDelayMs": (300, 0),
    "maxSafePages": (1000, 1), "navigationTimeoutMs": (60_000, 1000),
}
#: The same of those that may be stored too.
STORED = {"optionCartQty": (1, 1), "detailRequestDelayMs": (1000, 0), "detailMaxProducts": (0, 0)}
SWITCHES = {"showBrowser": False, "clearCartBefore": True, "clearCartAfter": False}
MODES = ("general", "detail")
LARGEST_PAGE_B, WORKERS_A, WORKERS_B = 40, 3, 5
#: What may be shown of a run's settings; accounts, keys and proxies may not.
SHOWN = (
    "mall", "category", "collectionMode", "accountName", "showBrowser", "pageStart", "pageEnd", "pageSize", "maxPerPage", "cartQty", "optionCartQty",
    "clearCartBefore", "clearCartAfter", "lowStockThreshold", "requestDelayMs", "detailRequestDelayMs", "detailMaxProducts", "detailConcurrency",
    "maxSafePages", "navigationTimeoutMs", "proxySource", "proxyProfileName",
)


def category(given: Column, mall: Column) -> Column:
    """A category code as given, or as a list url names it, else the mall's default."""
    raw = strip(F.coalesce(given, F.lit("")))
    is_url = F.try_parse_url(raw, F.lit("HOST")).isNotNull()
    out = F.lit(None).cast("string")
    for name, (parameter, default, _) in MALLS.items():
        named = F.coalesce(F.nullif(query_value(raw, parameter), F.lit("")), F.lit(default))
        out = F.when(mall == name, F.when(raw == "", default).when(is_url, named).otherwise(raw)).otherwise(out)
    return out


def resolve(requests: DataFrame, stored: dict[str, str] | None = None) -> DataFrame:
    """``requests`` (settings as texts, any may lack) with all settings resolved and ``settingsError``, null if they can be run."""
    kept = {k: v for k, v in (stored or {}).items() if v.strip()}
    text = {c: F.col(c).cast("string") for c in requests.columns}
    asked = lambda name: F.when(has_text(text[name]), text[name]) if name in text else F.lit(None).cast("string")
    either = lambda name: F.coalesce(asked(name), F.lit(kept.get(name)).cast("string"))
    mall = F.lower(strip(F.coalesce(asked("mall"), F.lit("mall-a"))))
    mode = F.lower(strip(F.coalesce(either("collectionMode"), F.lit(MODES[0]))))
    size_a, size_b = (to_integer(either("pageSize"), MALLS[m][2], 1) for m in ("mall-a", "mall-b"))
    whole = {n: to_integer(asked(n), *v) for n, v in ASKED.items()} | {n: to_integer(either(n), *v) for n, v in STORED.items()}
    start, end, most = whole["pageStart"], whole["pageEnd"], whole["maxSafePages"]
    error = (
        F.when(~mall.isin(*MALLS), "unknown mall").when(~mode.isin(*MODES), "unknown collection mode")
        .when((end > 0) & (end < start), "last page before the first").when(end > most, "too many pages")
    )
    return requests.withColumns(
        {
            "mall": mall, "category": category(asked("category"), mall), "collectionMode": mode, **whole,
            "pageSize": F.when(mall == "mall-b", F.least(size_b, F.lit(LARGEST_PAGE_B))).otherwise(size_a),
            **{n: to_boolean(asked(n), F.lit(v)) for n, v in SWITCHES.items()},
            "detailConcurrency": F.when(mall == "mall-b", F.lit(WORKERS_B).cast("bigint")).otherwise(to_integer(either("detailConcurrency"), WORKERS_A, 1)),
            "settingsError": error,
        }
    )


def shown(settings: DataFrame) -> DataFrame:
    """The columns that may be shown, and whether there is a proxy."""
    proxy = F.col("proxy").isNotNull() if "proxy" in settings.columns else F.lit(False)
    return settings.select(*[c for c in SHOWN if c in settings.columns], proxy.alias("proxyEnabled"))
