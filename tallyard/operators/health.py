"""Run health: page scans, cycles and their risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions.text import display_number, first_text

# fixed values: thresholds of the alarms
SLOWDOWN, NODES, NODE_GROWTH, HEAP_MB, HEAP_GROWTH, WINDOW, REFRESH_EVERY = 2.2, 15_000, 1.6, 120, 1.45, 5, 6


def cycle_risks(cycles: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Adds the alarms of each cycle against up to four before it; needs three cycles in the window.

    Windows are by run; a run's cycles are few.
    """
    w = Window.partitionBy(*(run or [])).orderBy("cycleNo").rowsBetween(-(WINDOW - 1), -1)
    before = F.count("*").over(w)
    mean = F.round(F.avg(F.when(F.col("msPerProduct") > 0, F.col("msPerProduct").cast("decimal(18,4)"))).over(w), 2)
    nodes, heap = F.max("maxDomNodes").over(w), F.max("maxHeapMb").over(w)
    enough = before >= 2
    slow = enough & (F.col("msPerProduct") > 0) & (F.col("msPerProduct").cast("decimal(18,4)") > mean * F.lit(SLOWDOWN).cast("decimal(3,1)"))
    dom = enough & (F.col("maxDomNodes") > NODES) & (F.col("maxDomNodes") > nodes * NODE_GROWTH)
    grown = enough & (heap > HEAP_MB) & (F.col("maxHeapMb") > heap * HEAP_GROWTH)
    flag = lambda c, text: F.when(F.coalesce(c, F.lit(False)), text)
    reasons = F.array_compact(F.array(flag(slow, "slowdown"), flag(dom, "dom-node-growth"), flag(grown, "js-heap-growth")))
    forced = F.col("cycleNo") % REFRESH_EVERY == 0
    return cycles.withColumn("reasons", reasons).withColumn("forcedRefresh", forced).withColumn("label", risk_label(reasons, forced))


def risk_label(reasons: Column, forced: Column) -> Column:
    """Distinct reasons joined, a forced refresh first."""
    named = F.filter(F.array_distinct(F.transform(reasons, lambda r: F.trim(r))), lambda r: r != "")
    return F.array_join(F.concat(F.when(forced, F.array(F.lit("periodic-refresh"))).otherwise(F.array().cast("array<string>")), named), ", ")


def cycle_summary(pages: DataFrame, cycle: list[str], order: str) -> DataFrame:
    """Figures of each cycle from those of its pages that took time."""
    taken = pages.filter(F.col("elapsedMs") > 0)
    return taken.groupBy(*cycle).agg(
        F.count("*").alias("pages"), F.sum("elapsedMs").alias("elapsedMs"), F.max("elapsedMs").alias("slowestPageMs"),
        F.avg("elapsedMs").alias("meanPageMs"), F.min_by("domNodes", order).alias("firstDomNodes"), F.max_by("domNodes", order).alias("lastDomNodes"),
        F.max("domNodes").alias("maxDomNodes"),
    )


def page_scan(rows: DataFrame, page: str = "page", run: list[str] | None = None, stop_without_new: bool = True) -> DataFrame:
    """Pages of a scan with status (kept, empty-page, duplicate-page, no-new-products, after-stop).

    ``rows``: page and productId (null on an empty page). A page is a duplicate if its sorted
    ids are those of the page before. Windows run over pages, not products.
    """
    run = run or []
    ids = F.array_sort(F.collect_set("productId"))
    first = rows.filter("productId is not null").groupBy(*run, "productId").agg(F.min(page).alias(page)).groupBy(*run, page).agg(F.count("*").alias("added"))
    pages = rows.groupBy(*run, page).agg(ids.alias("ids"), F.count("productId").alias("total")).join(first, [*run, page], "left")
    w = Window.partitionBy(*run).orderBy(page)
    pages = pages.withColumn("added", F.coalesce("added", F.lit(0))).withColumn("signature", F.array_join("ids", ",")).withColumn("before", F.lag("signature").over(w))
    own = F.when(F.col("total") == 0, "empty-page").when(F.col("signature") == F.col("before"), "duplicate-page")
    if stop_without_new:
        own = own.when(F.col("added") == 0, "no-new-products")
    pages = pages.withColumn("own", own)
    stopped = F.min(F.when(F.col("own").isNotNull(), F.col(page))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    status = F.when(stopped.isNull(), "kept").when(stopped == F.col(page), F.col("own")).otherwise("after-stop")
    return pages.select(*run, page, "total", "added", status.alias("status"))


def page_counters(products: DataFrame) -> DataFrame:
    """Products by page: all, active, sold out, and those first seen there."""
    first = products.groupBy("productId").agg(F.min("page").alias("page")).groupBy("page").agg(F.count("*").alias("added"))
    counts = products.groupBy("page").agg(F.count("*").alias("total"), F.count_if(~F.col("isSoldOut")).alias("active"), F.count_if("isSoldOut").alias("soldOut"))
    return counts.join(first, "page", "left").withColumn("added", F.coalesce("added", F.lit(0)))


def page_range(mode: str, first: int, last: int, available: int | None, cap: int = 1000) -> tuple[int, int]:
    """Pages to read: manual as given, auto to the end, manual-capped to the end or ``last``."""
    if first < 1 or (mode != "auto" and last < first):
        raise ValueError("bad page range")
    end = last if mode == "manual" else available if mode == "auto" else min(last, available or last)
    if end is None:
        raise ValueError("auto needs the last page")
    return first, min(max(end, first), first + cap - 1)


def page_ranges(runs: DataFrame) -> DataFrame:
    """``runs`` (pageStart, pageEnd, detectedLastPage) with mode, the last page to read, and an error where the first is beyond it.

    An end of 0 reads to the last page detected ("auto"); an end beyond that is cut to it ("manual-capped").
    """
    known, asked = F.col("detectedLastPage") > 0, F.col("pageEnd")
    mode = F.when(asked == 0, "auto").when(F.coalesce(known, F.lit(False)) & (asked > F.col("detectedLastPage")), "manual-capped").otherwise("manual")
    found = runs.withColumn("mode", mode).withColumn("resolvedEnd", F.when(F.col("mode") == "manual", asked).otherwise(F.col("detectedLastPage")))
    late = F.col("resolvedEnd").isNull() | (F.col("pageStart") > F.col("resolvedEnd"))
    return found.withColumn("error", F.when(late, F.concat(F.lit("first page "), F.col("pageStart").cast("string"), F.lit(" is beyond the last, "), F.coalesce(F.col("resolvedEnd").cast("string"), F.lit("unknown")))))


def catalog_info(pages: DataFrame, page_size: int, prefer_count: bool = True) -> DataFrame:
    """Adds lastPage from totalCount and linkedLast (either may be null); one page at least."""
    by_count = F.when(F.col("totalCount") > 0, F.ceil(F.col("totalCount") / page_size))
    order = [by_count, F.col("linkedLast")] if prefer_count else [F.col("linkedLast"), by_count]
    return pages.withColumn("lastPage", F.greatest(F.coalesce(*order, F.lit(1)), F.lit(1)).cast("int"))


def run_summary(pages: DataFrame, products: DataFrame, expected: int | None, full_range: bool) -> DataFrame:
    """One row about a run; countMatched only if the whole range was read."""
    p = pages.agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "kept").alias("keptPages"), F.first(F.when(F.col("status").isin("kept", "after-stop"), None).otherwise(F.col("status")), True).alias("stopReason"))
    sold = products.agg(F.count_distinct("productId").alias("products"), F.count_distinct(F.when(F.col("isSoldOut") | F.coalesce("unavailableInCart", F.lit(False)), F.col("productId"))).alias("soldOut"))
    matched = (F.col("products") == expected) if full_range and expected is not None else F.lit(None).cast("boolean")
    return p.crossJoin(sold).withColumn("stopReason", F.coalesce(first_text(F.col("stopReason")), F.lit("completed-range"))).withColumn("countMatched", matched)


def active_runs(runs: DataFrame) -> DataFrame:
    """Number of running runs and the latest completed one."""
    done = F.when(F.col("status") == "completed", F.coalesce("finishedAt", "updatedAt", "startedAt"))
    return runs.agg(F.count_if(F.col("status").isin("queued", "running")).alias("activeRuns"), F.max_by(F.when(done.isNotNull(), F.col("runId")), done).alias("latestCompleted"))


def elapsed(now: Column) -> Column:
    """Live while running, else the reported value."""
    return F.when(F.col("status") == "running", F.unix_millis(now) - F.unix_millis(F.col("startedAt"))).otherwise(F.coalesce("progressMs", "summaryMs"))


#: Counts a run shows, each from the first of these fields that its summary, else its progress has.
METRICS = {
    "detected": ("detectedTotalProductCount",), "collected": ("collectedProductCount",), "target": ("targetProductCount",),
    "inventory": ("inventoryRowCount", "productSummaryCount"), "soldOut": ("soldOutProductCount",),
}


def metrics(runs: DataFrame) -> DataFrame:
    """Adds the texts of ``METRICS`` and excluded (0 unless stated, only for mall-a) of runs with structs summary and progress."""
    first = lambda names: F.coalesce(*[F.col(f"{part}.{n}") for n in names for part in ("summary", "progress")])
    excluded = F.when(F.col("mall") == "mall-a", display_number(F.coalesce(first(["excludedProductCount"]), F.lit(0))))
    return runs.withColumns({**{card: display_number(first(names)) for card, names in METRICS.items()}, "excluded": excluded})
