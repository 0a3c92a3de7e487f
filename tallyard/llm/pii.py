"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose candidate spans. The four base kinds that pass their checks (email, ip,
card, phone) always stay; further kinds (secret, ssn, iban, url-login) are decided by a
classifier. Every candidate gets votes (for, against, abstain) of labelers: the pattern's
own check, gazetteers of cue words near it, and its context (quotes, assignment signs,
neighbouring letters). Expectation-maximisation over the counts of vote patterns of all
candidates (a table bounded by kinds x 3^labelers, never by the data) estimates each
labeler's reliability and each pattern's posterior. The final classifier does not see the
votes: it is a logistic model, one for each kind, over features of the span itself
(length, shares of digits, capitals and different characters, what stands on either side),
trained on the posteriors and applied as a column expression.

Defined results: null and empty texts have no spans; spans of different kinds may overlap and
are all reported, and redaction masks their union; repeated rows are scanned each; columns
other than those named are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.llm.common import materialise, text_of

# fixed values: base patterns, possessive where that can't change a match. Those that begin with
# a run begin at its head only, or where the last match ended: a match that begins further on could
# begin there too, and a long run is read once instead of once from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{20,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "url-login": r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s/@:]++:[^\s/@]++@",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: Texts without this can't hold the kind.
GATES = {"email": "@", "phone": "+", "url-login": "@"}
CUES = {
    "email": "mail|contact|write|from|to|cc",
    "ip": "ip|address|host|server|client|login",
    "card": "card|visa|credit|payment|pan|account|acct",
    "phone": "phone|call|tel|fax|mobile|cell",
    "secret": "token|secret|key|api|apikey|password|passwd|pwd|auth|bearer|credential|credentials",
    "ssn": "ssn|social|security",
    "iban": "iban|account|bank|transfer",
    "url-login": "url|dsn|connect|connection|database",
}
#: Characters on either side that labelers see; of a block of text.
CONTEXT, BLOCK = 32, 4096
LABELERS = ("check", "cue", "assigned", "quoted", "apart", "varied")

#: One digit for each: length by doublings; quarters of digits, of capitals and of different characters; kind of character to the left and right.
FEATURES = ("length", "digits", "capitals", "different", "left", "right")

SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean,votes:string,features:string>"


# --- candidates -------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, though the body names it often."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, largest: bool = False) -> Column:
    """Sum, or maximum, of the elements before each element (0 for the first), in blocks, so that long arrays stay cheap."""
    block = 128

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x) if largest else a + x)

    def prefix(own: Column) -> Column:
        count = F.ceil(F.size(own) / block).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count - 1), lambda b: total(F.slice(own, b * block + 1, block)))

        def within(pair: Column) -> Column:
            bases = F.transform(pair["sums"], lambda _, i: total(F.slice(pair["sums"], F.lit(1), i)))

            def one(p: Column, i: Column) -> Column:
                base = F.get(p["bases"], F.floor(i / block).cast("int"))
                own_part = total(F.slice(p["own"], (F.floor(i / block) * block + 1).cast("int"), F.pmod(i, F.lit(block)).cast("int")))
                return F.greatest(base, own_part) if largest else base + own_part

            return _let(F.struct(bases.alias("bases"), pair["own"].alias("own")), lambda p: F.transform(p["own"], lambda _, i: one(p, i)))

        return _let(F.struct(sums.alias("sums"), own.alias("own")), within)

    return _let(values, lambda own: F.when(F.size(own) > 0, prefix(own)).otherwise(F.array().cast("array<bigint>")))


def _blocks(text: Column) -> Column:
    """``text`` in blocks of ``BLOCK`` code points: finding a place in a long text means counting from its start."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def _near(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` on, at most one block of them."""
    at = F.floor(start / BLOCK).cast("int")
    two = F.concat(F.get(blocks, at), F.coalesce(F.get(blocks, at + 1), F.lit("")))
    return F.coalesce(F.substring(two, (F.pmod(start, F.lit(BLOCK)) + 1).cast("int"), length.cast("int")), F.lit(""))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end``, however many."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    joined = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(joined, (F.pmod(start, F.lit(BLOCK)) + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """The kind's own check of a match."""
    if kind == "ip":
        def small(part: Column) -> Column:
            plain = F.regexp_replace(part, "^0+(?=.)", "")
            return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(999)) <= 255)

        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return _let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "secret":
        # letters and digits in turn, as random strings have them
        return value.rlike("[0-9][A-Za-z]") & value.rlike("[A-Za-z][0-9]")
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit("+")).when(no, F.lit("-")).otherwise(F.lit("0"))


def _votes(kind: str, value: Column, left: Column, right: Column) -> Column:
    """One character per labeler: +, - or 0 (abstains)."""
    cue = rf"(?i)(?:^|[^a-z])(?:{CUES[kind]})[^a-z]*+[^\n]{{0,12}}$"
    return F.concat(
        _vote(_valid(kind, value), ~_valid(kind, value)),
        _vote(left.rlike(cue), F.length(left) < 0),
        _vote(left.rlike(r"[=:]\s*[\"']?$"), left.rlike(r"[A-Za-z0-9]$")),
        _vote(left.rlike(r"[\"'<(]$") & right.rlike(r"^[\"'>)]"), F.lit(False)),
        _vote(left.rlike(r"(?:^|\s|[\"'(<=:])$") & right.rlike(r"^(?:$|\s|[\"')>.,;!?])"), left.rlike(r"[0-9A-Za-z]$") | right.rlike(r"^[0-9A-Za-z]")),
        # few different characters speak against data
        _vote(F.size(F.array_distinct(F.split(value, ""))) >= 6, F.size(F.array_distinct(F.split(value, ""))) <= 3),
    )


def _features(value: Column, left: Column, right: Column) -> Column:
    n = F.greatest(F.length(value), F.lit(1))
    quarters = lambda count: F.floor(4 * count / n).cast("int").cast("string")

    def side(x: Column, at: str) -> Column:
        is_ = lambda kinds: x.rlike(f"^[{kinds}]" if at == "start" else f"[{kinds}]$")
        return F.when(x == "", "0").when(is_(r"\s"), "1").when(is_("A-Za-z"), "2").when(is_("0-9"), "3").when(is_(r"\"'<>()\[\]{}"), "4").otherwise("5")

    return F.concat(
        F.least(F.floor(F.log2(n)), F.lit(9)).cast("int").cast("string"), quarters(F.length(_digits(value))),
        quarters(F.length(F.regexp_replace(value, "[^A-Z]", ""))), quarters(F.size(F.array_distinct(F.split(value, "")))),
        side(left, "end"), side(right, "start"),
    )


def _found(kind: str, text: Column) -> Column:
    """Candidate spans of one kind: leftmost, not overlapping; positions in code points."""
    pattern = PATTERNS[kind]

    def body(own: Column) -> Column:
        lengths = F.transform(own["matches"], lambda m: F.length(m).cast("long"))
        gaps = F.transform(own["gaps"], lambda g: F.length(g).cast("long"))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(own["matches"])), lengths, lambda g, m: g + m)

        def placed(p: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(p["starts"], i) + F.length(F.get(p["gaps"], i))
                return _let(F.struct(m.alias("value"), start.alias("start"), p["blocks"].alias("blocks")), judged)

            return F.transform(p["matches"], one)

        def judged(p: Column) -> Column:
            stop = p["start"] + F.length(p["value"])
            left = _near(p["blocks"], F.greatest(p["start"] - CONTEXT, F.lit(0)), F.least(p["start"], F.lit(CONTEXT)))
            right = _near(p["blocks"], stop, F.lit(4))
            base = _valid(kind, p["value"]) if kind in BASE else F.lit(False)
            return F.struct(
                F.lit(kind).alias("kind"), p["start"].cast("long").alias("start"), stop.cast("long").alias("end"), base.alias("base"),
                _votes(kind, p["value"], left, right).alias("votes"), _features(p["value"], left, right).alias("features"),
            )

        return _let(F.struct(own["matches"].alias("matches"), own["gaps"].alias("gaps"), own["blocks"].alias("blocks"), _before(steps).alias("starts")), placed)

    none = F.array().cast(f"array<{SPAN}>")
    present = text.contains(GATES[kind]) if kind in GATES else text.rlike("[0-9]")
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps"), _blocks(text).alias("blocks"))
    return F.when(present & text.rlike(pattern), _let(parts, body)).otherwise(none)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by kind and start."""
    return F.flatten(F.array(*[_found(k, text) for k in KINDS]))


# --- weak supervision -------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Reliability of each labeler, and of each kind and feature value (``kind:place:value``) its weight in the classifier."""

    reliability: dict[str, dict[str, float]] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def probability(self, span: Column) -> Column:
        z = F.lit(0.0)
        for kind, b in self.bias.items():
            own = F.lit(b)
            for i in range(len(FEATURES)):
                known = {k.rsplit(":", 1)[1]: w for k, w in self.weights.items() if k.startswith(f"{kind}:{i}:")}
                digit, part = F.substring(span["features"], i + 1, 1), F.lit(0.0)
                for value, w in sorted(known.items()):
                    part = F.when(digit == value, F.lit(w)).otherwise(part)
                own = own + part
            z = F.when(span["kind"] == kind, own).otherwise(z)
        return 1 / (1 + F.exp(-z))


def fit(spans: DataFrame, rounds: int = 40) -> Model:
    """EM over vote patterns, then the classifier. ``spans``: an array column ``spans``."""
    counted = (
        spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
    )  # at most kinds x 3^labelers rows
    cells = [(r["kind"], r["votes"], r["n"]) for r in counted]
    if not cells:
        return Model()
    kinds = sorted({k for k, _, _ in cells})
    # start: a majority of votes, the pattern's own check counting twice
    post = []
    for _, votes, _ in cells:
        lean = sum({"+": 1, "-": -1, "0": 0}[v] * (2 if i == 0 else 1) for i, v in enumerate(votes))
        post.append(1 / (1 + math.exp(-1.5 * (lean - 0.5))))
    chance: list[dict] = []
    for _ in range(rounds):
        prior = {}
        for kind in kinds:
            own = [(p, n) for (k, _, n), p in zip(cells, post, strict=True) if k == kind]
            prior[kind] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        chance = []
        for i in range(len(LABELERS)):
            table = {(v, y): 0.5 for v in "+-0" for y in (0, 1)}
            # labelers are better than chance: what they say for a class counts a little for it
            table["+", 1] += 2
            table["-", 0] += 2
            for (_, votes, n), p in zip(cells, post, strict=True):
                table[votes[i], 1] += n * p
                table[votes[i], 0] += n * (1 - p)
            sums = [sum(table[v, y] for v in "+-0") for y in (0, 1)]
            chance.append({(v, y): table[v, y] / sums[y] for v in "+-0" for y in (0, 1)})
        new = []
        for kind, votes, _ in cells:
            z = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(chance[i][v, 1] / chance[i][v, 0]) for i, v in enumerate(votes))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        post = new
    reliability = {name: {"for": c["+", 1] / (c["+", 1] + c["+", 0]), "against": c["-", 0] / (c["-", 1] + c["-", 0])} for name, c in zip(LABELERS, chance, strict=True)}
    told = F.create_map(*[x for (k, v, _), p in zip(cells, post, strict=True) for x in (F.lit(f"{k}:{v}"), F.lit(p))])
    seen = spans.select(F.explode("spans").alias("s")).filter(~F.col("s.kind").isin(*BASE))
    seen = seen.select("s.kind", "s.features", told[F.concat_ws(":", "s.kind", "s.votes")].alias("p"))
    # at most kinds x 10 x 5^3 x 6^2 rows, whatever the data
    seen = seen.groupBy("kind", "features").agg(F.count("*").alias("n"), F.avg("p").alias("p")).orderBy("kind", "features").collect()
    bias, weights = {}, {}
    for kind in sorted({r["kind"] for r in seen}):
        own = [([f"{kind}:{i}:{v}" for i, v in enumerate(r["features"])], r["n"], r["p"]) for r in seen if r["kind"] == kind]
        bias[kind], found = _logistic(own)
        weights.update(found)
    return Model(reliability, bias, weights)


def _logistic(cells: list[tuple[list[str], int, float]], steps: int = 120) -> tuple[float, dict[str, float]]:
    """Bias and weights of a logistic model of (features, count, target), by gradient steps with a small penalty."""
    total = sum(n for _, n, _ in cells)
    bias, weights = 0.0, {name: 0.0 for names, _, _ in cells for name in names}
    for step in range(steps):
        slope, slopes = 0.0, dict.fromkeys(weights, 0.0)
        for names, n, p in cells:
            z = bias + sum(weights[x] for x in names)
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            slope += g
            for x in names:
                slopes[x] += g
        rate = 2.0 / (1 + step / 60)
        bias -= rate * slope
        for x, g in slopes.items():
            weights[x] -= rate * (g + 1e-4 * weights[x])
    return bias, weights


def decide(spans: Column, model: Model) -> Column:
    """Base spans and those that the classifier accepts, by start, then kind as listed."""
    # the added kinds need their own check as well as the classifier
    kept = F.filter(spans, lambda s: s["base"] | (~s["kind"].isin(*BASE) & s["votes"].startswith("+") & (model.probability(s) >= 0.5)))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    return F.array_sort(keyed)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each document."""
    found = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(text_of()).alias("spans")), "spans")
    kept = found.select("doc_id", decide(F.col("spans"), fit(found)).alias("kept"))
    count = lambda kind: F.size(F.filter("kept", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return kept.select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(joined(F.filter("kept", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("kept")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by the kind of its first, in brackets."""
    columns = docs.columns
    # texts are searched once; numbered names can't clash with those of the input
    found = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)], text_of().alias("text"), candidates(text_of()).alias("spans"))
    found = materialise(found.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "spans")
    model = fit(found)
    text = F.col("text")

    def mask(own: Column) -> Column:
        """What stands between runs of spans, with a mark for the first of each run."""
        ends = F.transform(own["spans"], lambda s: s["end"])

        def marked(p: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                reached = F.get(p["reached"], i)
                mark = F.concat(_between(p["blocks"], reached, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
                return F.when(s["start"] >= reached, mark).otherwise("")

            tail = _between(p["blocks"], F.greatest(F.get(p["reached"], F.size("spans") - 1), F.get(p["ends"], F.size("spans") - 1)), F.length(text))
            return F.concat(F.array_join(F.transform(p["spans"], one), ""), tail)

        return _let(F.struct(own["spans"].alias("spans"), own["blocks"].alias("blocks"), ends.alias("ends"), _before(ends, largest=True).alias("reached")), marked)

    kept = found.withColumn("spans", F.when(F.size("spans") > 0, decide(F.col("spans"), model)))
    masked = F.when(F.coalesce(F.size("spans"), F.lit(0)) > 0, _let(F.struct(F.col("spans"), _blocks(text).alias("blocks")), mask))
    return kept.select(*[F.coalesce(masked, F.col(f"_k{i}")).alias(c) if c == "text" else F.col(f"_k{i}").alias(c) for i, c in enumerate(columns)])
