"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. Documents have an importance x, and a document
is wanted min(3, level * x) times, with the level at which a source's documents, times
their words, bring its target. It is taken the whole part of that many times for certain,
and once more with the rest as its inclusion probability p: documents are ranked by

    q = (u / (1 - u)) / (p / (1 - p))

with a random number ``u`` of the document, and the lowest ranks are taken. Importance
grows with the logarithm of a document's length unless another column is given; it is
rounded to quarters of a doubling, so a source has few different ones. The size of the
sample is fixed: ranks are taken until the words they bring meet what certain copies
leave of the target, to within half of the document at the border.

``u`` is a hash of doc_id, source, text hash, seed and the row's number among equal rows, so
reruns agree. Ranks are never gathered by source: words are summed by (source, slice of
``u``), the slices' running sums find the slice that the border falls into, and only
that slice (1/65536 of a source) is ordered row by row.

Defined results: null text has size 0; a null source is a source of its own, ordered
last; a source without words takes nothing of size; repeated rows are sampled each for
itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyard.llm.common import lookup_join, materialise, text_of

#: Slices of the rank scale for which words are summed.
SLICES = 65_536
#: Slices summed together first.
BLOCK = 256

#: Sources whose targets are broadcast; with more, they are joined by shuffle with salted hot sources.
FEW_SOURCES = 5_000

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)

#: A target stops at this many times the words of its source.
MOST_COPIES = 3

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, counted inside the JVM without making them."""
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]+", "")).cast("long")


def _targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source_key, source_size, target of each source: water filling of all words.

    In the optimum a source's target is min(most * size, level * weight). Sources are
    ordered by the level at which they fill up, size / weight; running sums over that
    order give the level. One row per source takes part, never a row per document.
    """
    order = Window.orderBy(F.col("source_null"), F.col("source_key"))
    numbered = sources.withColumn("ord", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("ord"), F.lit(len(weights))).cast("int") + 1)
    numbered = numbered.withColumn("weight", weight).withColumn("fills_at", most * F.col("source_size") / F.col("weight"))
    up_to = Window.orderBy("fills_at", "ord").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("fills_at", "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = (
        numbered.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum(most * F.col("source_size")).over(up_to), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
        # the first source, in this order, that the level doesn't fill sets the level of all that follow
        .withColumn("stays_open", F.col("level") <= F.col("fills_at"))
    )
    level = levelled.withColumn("final", F.min(F.when(F.col("stays_open"), F.struct("fills_at", "ord", "level"))).over(everything))
    return level.select(
        "source_key", "source_null", "source_size",
        F.when(F.col("final").isNull(), most * F.col("source_size").cast("double"))
        .otherwise(F.least(most * F.col("source_size").cast("double"), F.col("final.level") * F.col("weight"))).alias("target"),
    )


def by_length() -> Column:
    """Importance of a document: the logarithm of its words."""
    return F.log2(word_count(text_of()) + 2)


def _quarter(importance: Column) -> Column:
    """Quarters of a doubling that an importance is nearest to, from -32 to 32; 0 for null and what isn't positive."""
    value = importance.cast("double")
    near = F.greatest(F.least(F.round(4 * F.log2(value)), F.lit(32.0)), F.lit(-32.0))
    return F.when((value > 0) & ~F.isnan(value), near).otherwise(F.lit(0.0)).cast("int")


def _weight(quarter: Column) -> Column:
    return F.pow(F.lit(2.0), quarter / 4)


def _levels(marks: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """``targets`` with ``level``, null if all documents are taken ``most`` times, and ``wanted``, the words that certain copies leave."""
    key = ["source_key", "source_null"]
    cells = marks.groupBy(*key, "quarter").agg(F.sum("size").cast("double").alias("words"))  # 65 rows a source at most
    cells = cells.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("quarter", "words")), asc=False).alias("cells"))
    total = lambda part, value: F.aggregate(part, F.lit(0.0), lambda a, x: a + value(x))

    def of_full(n: Column) -> Column:
        """The level if the n most important cells are taken ``most`` times."""
        full, rest = F.slice("cells", F.lit(1), n), F.slice("cells", n + 1, F.size("cells"))
        spread = total(rest, lambda x: _weight(x["quarter"]) * x["words"])
        return F.struct(F.when(spread > 0, (F.col("target") - most * total(full, lambda x: x["words"])) / spread).alias("level"), rest[0]["quarter"].alias("next"))

    steps = F.transform(F.sequence(F.lit(0), F.size("cells") - 1), of_full)
    fit = F.filter(steps, lambda s: s["level"] * _weight(s["next"]) <= most)
    found = targets.join(cells, key).withColumn("level", F.get(fit, F.lit(0))["level"])
    sure = total(F.col("cells"), lambda x: x["words"] * F.floor(_share(x["quarter"], most)))
    return found.withColumn("wanted", F.greatest(F.col("target") - sure, F.lit(0.0))).drop("cells")


def _share(quarter: Column, most: int) -> Column:
    """Times that a document is wanted; what equals whole copies must not leave a crumb of rounding."""
    times = F.round(F.least(F.lit(float(most)), F.col("level") * _weight(quarter)), 12)
    return F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("level").isNull(), F.lit(float(most))).otherwise(times)


def sample(
    docs: DataFrame, keep: list[str], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES,
    importance: Column | None = None, seed: int = 17,
) -> DataFrame:
    """Columns of ``keep`` plus size, source_size, target, copies: one row per input row.

    ``importance`` (positive, 1 if not given) multiplies how often a document is wanted.
    """
    drawn = _drawn(docs, keep, weights, most, importance, seed)
    return drawn.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", "copies")


def _numbered(marks: DataFrame) -> DataFrame:
    """``marks`` (materialised) with ``nth``, the number of each row among those of its mark.

    Rows are numbered within their part of the input, and parts by the rows before them, so
    that no task gets all rows of a mark.
    """
    again = materialise(marks.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"), "mix-again")
    if again.isEmpty():
        return marks.withColumn("nth", F.lit(1).cast("long"))
    parted = marks.withColumn("part", F.shiftright("row", 33))
    repeated = lookup_join(parted, again, "mark", ["row"])
    local = repeated.withColumn("local", F.row_number().over(Window.partitionBy("mark", "part").orderBy("row")))
    counts = repeated.groupBy("mark", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mark").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("mark", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = local.join(counts, ["mark", "part"]).withColumn("nth", F.col("local") + F.col("before")).drop("local", "before", "part")
    single = parted.join(again, "mark", "left_anti").drop("part").withColumn("nth", F.lit(1).cast("long"))
    return materialise(single.unionByName(placed), "mix-marks")


def _drawn(docs: DataFrame, keep: list[str], weights: tuple[int, ...], most: int, importance: Column | None, seed: int) -> DataFrame:
    """The sample with the columns of ``keep`` under numbered names, which can't clash."""
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    size = word_count(text_of())
    marks = docs.select(
        *named, size.alias("size"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"), F.col("source").isNull().alias("source_null"),
        (F.lit(0) if importance is None else _quarter(importance)).alias("quarter"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.md5(F.col("source").cast("string")), F.lit("")), F.md5(text_of())).alias("mark"),
        F.monotonically_increasing_id().alias("row"),
    )
    marks = materialise(marks, "mix-marks")
    sources = marks.groupBy("source_key", "source_null").agg(F.sum("size").cast("long").alias("source_size"))
    targets = materialise(_levels(marks, _targets(sources, weights, most), most), "mix-targets")
    few = targets.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    key = ["source_key", "source_null"]

    marks = _numbered(marks)
    u_of = lambda number: (F.pmod(F.xxhash64("mark", number), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    if few:
        joined = marks.join(F.broadcast(targets), key)
    else:
        text_key = F.concat(F.col("source_null").cast("string"), F.lit(":"), F.col("source_key"))
        joined = lookup_join(
            marks.withColumn("_source", text_key), targets.withColumn("_source", text_key).drop(*key), "_source", ["row"]
        ).drop("_source")
    u = u_of(F.col("nth"))
    p = F.least(F.greatest(F.col("fraction"), F.lit(1e-12)), F.lit(1 - 1e-12))
    ranked = (
        joined.withColumn("share", _share(F.col("quarter"), most))
        .withColumn("certain", F.floor("share").cast("int"))
        .withColumn("fraction", F.col("share") - F.floor("share"))
        # documents that are wanted whole times only have no rank
        .withColumn("wanted", F.when(F.col("fraction") > 0, F.col("wanted")).otherwise(F.lit(0.0)))
        .withColumn("u", u)
        .withColumn("q", (F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
        # q / (1 + q) maps the ranks to 0..1 in order
        .withColumn("slice", F.floor(F.col("q") / (1 + F.col("q")) * F.lit(SLICES)).cast("int"))
    )
    cells = ranked.filter("wanted > 0").groupBy(*key, "slice").agg(F.sum("size").alias("words"), F.max("wanted").alias("wanted"))
    cells = materialise(cells.withColumn("block", F.expr(f"slice div {BLOCK}")), "mix-cells")
    # the border's block of slices, then its slice: no window is longer than a block, or than there are blocks
    blocks = cells.groupBy(*key, "block").agg(F.sum("words").alias("words"), F.max("wanted").alias("wanted"))
    running = lambda by, order: F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = (F.col("before") < F.col("wanted")) & (F.col("before") + F.col("words") >= F.col("wanted"))
    blocks = blocks.withColumn("before", running(key, "block")).filter(reached).select(*key, "block", F.col("before").alias("block_before"))
    border = cells.join(blocks, [*key, "block"]).withColumn("before", F.col("block_before") + running(key, "slice")).filter(reached)
    border = border.select(*key, F.col("slice").alias("border"), F.col("before").alias("border_before"))
    border = materialise(border, "mix-border")  # one row per source at most
    if few:
        placed = ranked.join(F.broadcast(border), key, "left")
    else:
        text_key = F.concat(F.col("source_null").cast("string"), F.lit(":"), F.col("source_key"))
        placed = lookup_join(
            materialise(ranked.withColumn("_source", text_key), "mix-ranked"),
            border.withColumn("_source", text_key).drop(*key), "_source", ["row"], "left",
        ).drop("_source")
    within = Window.partitionBy(*key).orderBy("q", "mark", "nth").rowsBetween(Window.unboundedPreceding, -1)
    at_border = (
        placed.filter("wanted > 0 and slice = border")
        .withColumn("so_far", F.col("border_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        # taken if that brings the sum nearer to what is wanted
        .withColumn("extra", (F.col("so_far") + F.col("size") / 2 <= F.col("wanted")).cast("int"))
        .drop("so_far")
    )
    rest = placed.filter("not (wanted > 0 and border is not null and slice = border)").withColumn(
        "extra", F.when(F.col("wanted") <= 0, 0).when(F.col("border").isNull(), 1).when(F.col("slice") < F.col("border"), 1).otherwise(0)
    )
    out = rest.unionByName(at_border)
    return out.withColumn("copies", (F.col("certain") + F.col("extra")).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 17) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the sample takes it."""
    columns = docs.columns
    picked = _drawn(docs, columns, weights, most, by_length(), seed).filter("copies > 0")
    repeated = picked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(columns)])
