"""Personal data by boosted trees over candidate spans, with built-in functions and Spark ML only.

1. Generators: four strict patterns (their valid matches are the base spans, which always stay) and looser ones that propose
   overlapping spans: dotted numbers, digit runs and groups, written-out addresses, numbers without their neighbours. A text
   is split at the matches of a pattern; lengths of the parts, summed in order, give places in code points. Patterns start
   only where a run of their characters starts, so their time is linear in the text.
2. Every candidate gets format features (lengths, counts of characters by class, groups, Luhn, largest number) and context
   features (what stands next to it, key words before it).
3. Gradient-boosted trees are fitted on at most SAMPLE candidates, drawn by hash, half of them base spans where there are as
   many; candidates that equal a base span are the positives. So the trees learn what base spans look like in format and
   company, and find them where a strict match ran into its neighbour and failed. A candidate inside such a failed match has
   no label, since the match may have failed because of what else it holds; the trees only judge it.
4. A fifth of the candidates, by a hash of the span and its surroundings, is kept out of the fit. For each kind the threshold
   is the lowest score above which at least the share PRECISION of these are base spans; candidates above it are added.

Defined cases: null text counts as empty; texts without candidates have no spans; without base spans, or without any other
candidate, nothing is learned and nothing added; equal rows are rows of their own; texts of any length are searched whole; a
null doc_id stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import joined, stored

KINDS = ("email", "ip", "card", "phone")
# Bound of the rows that the trees are fitted on, trees and their depth, and the share of base spans above a threshold.
SAMPLE, TREES, DEPTH, PRECISION = 20_000, 20, 4, 0.95
CONTEXT, STEPS = 24, 200

# (kind, is a base pattern, what a text must hold to be searched, pattern). A base pattern of the contract starts anywhere;
# here it starts where a run starts or the last match ended, and takes runs whole, which gives the same matches.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
GENERATORS = (
    ("email", True, "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    ("ip", True, r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, "[0-9]{2}|[0-9][ -][0-9]", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", True, r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email", False, "@", r"(?<![^\s@])[^\s@]++@[^\s@]++"),
    ("email", False, r"[\[(](?:at|AT)[\])]", rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[(](?:at|AT)[\])] ?{_LABEL}++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?{_LABEL}++)++"),
    ("ip", False, r"[0-9]\.[0-9]", r"(?<![0-9A-Za-z])[0-9]{1,3}(?:\.[0-9]{1,3}){2,5}(?![0-9])"),
    ("ip", False, r"[0-9]\[\.\][0-9]", r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])"),
    ("card", False, "[0-9]{7}", r"(?<![0-9])[0-9]{7,19}(?![0-9])"),
    ("card", False, "[0-9][ -][0-9]", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    ("card", False, "[0-9]{4}[ -][0-9]{4}", r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9])"),
    ("phone", False, r"\+[0-9]", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"),
    ("phone", False, r"\+[0-9]", r"\+[0-9]{1,3} ?\([0-9]{1,4}\) ?[0-9]{2,4}[ .-][0-9]{2,4}(?![0-9])"),
    ("phone", False, "[0-9]{3}[ .-][0-9]{3}", r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
)
_KEYWORDS = r"(?i)(?:tel|phone|call|fax|mail|contact|card|visa|credit|addr|host|server|\bip)\W*\w*\W*$"


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn test; asked for up to 25 of them."""
    turned, n = F.reverse(digits), F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when((n >= 1) & (n <= 25), total % 10 == 0).otherwise(False)


def _valid() -> Column:
    """Whether the match of a base pattern holds as a base span."""
    n = F.length(_digits(F.col("span")))
    return (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, F.col("span").rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"))
        .when(F.col("kind") == 2, n.between(14, 19) & _luhn(_digits(F.col("span"))))
        .otherwise(n.between(10, 15))
    )


def _matches(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(row, doc_id, text_sha256, hits): of each generator the matches in order, with the text between them as a length.

    Written once: rows are numbered by it, and texts are read only here.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    hits = []
    for i, (_, _, need, pattern) in enumerate(GENERATORS):
        between = F.split("text", pattern, -1)
        parts = F.arrays_zip(between.alias("gap"), F.slice(between, 2, 2147483646).alias("next"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("span"))
        # The last part has no match behind it.
        items = F.transform(
            F.filter(parts, lambda z: z["span"].isNotNull()),
            lambda z: F.struct(F.length(z["gap"]).alias("gap"), z["span"].alias("span"), F.right(z["gap"], F.lit(CONTEXT)).alias("before"), F.left(z["next"], F.lit(CONTEXT)).alias("after")),
        )
        hits.append(F.when(F.col("text").rlike(need), F.struct(F.lit(i).alias("generator"), items.alias("items"))))
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"), found.alias("hits")), "matches")


def candidates(matches: DataFrame) -> DataFrame:
    """One row for each (row, kind, start, end): span, before, after, ``base`` (a valid match of a base pattern) and ``labelled``."""
    spread = matches.select("row", F.explode("hits").alias("h")).select("row", "h.generator", F.posexplode("h.items").alias("pos", "i"))
    spread = spread.select("row", "generator", "pos", "i.*").withColumn("size", F.length("span"))
    so_far = W.partitionBy("row", "generator").orderBy("pos")
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(so_far.rowsBetween(W.unboundedPreceding, W.currentRow))
    kind = F.element_at(F.array(*[F.lit(KINDS.index(g[0])) for g in GENERATORS]), F.col("generator") + 1)
    strict = F.element_at(F.array(*[F.lit(g[1]) for g in GENERATORS]), F.col("generator") + 1)
    placed = spread.withColumns({"end": end, "kind": kind, "strict": strict}).withColumn("start", F.col("end") - F.col("size"))
    placed = placed.withColumn("base", F.col("strict") & _valid())
    # Matches of a base pattern that hold too few digits to be anything are no candidates.
    placed = placed.where(F.col("base") | (F.col("kind") == 0) | (F.length(_digits(F.col("span"))) >= F.when(F.col("kind") == 1, 3).otherwise(7)))
    near = F.max(F.struct("span", "before", "after")).alias("near")
    failed = F.max(F.col("strict") & ~F.col("base")).alias("failed")
    each = placed.groupBy("row", "kind", "start", "end").agg(F.max("base").alias("base"), failed, near)
    # Matches of one base pattern do not overlap, so the furthest end of those before tells what lies inside one.
    order = W.partitionBy("row", "kind").orderBy("start", F.desc("failed")).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = F.coalesce(F.max(F.when(F.col("failed"), F.col("end"))).over(order) >= F.col("end"), F.lit(False))
    labelled = F.col("base") | F.col("failed") | ~F.col("inside")
    return each.withColumn("inside", inside).select("row", "kind", "start", "end", "base", labelled.alias("labelled"), "near.*")


def _beside(char: Column) -> Column:
    """Class of the character next to a span."""
    return (
        F.when(char == "", 0).when(char.rlike(r"^\s$"), 1).when(char.rlike(r"^\p{L}$"), 2).when(char.rlike("^[0-9]$"), 3)
        .when(char.isin("\"", "'", "=", "_"), 4).when(char.isin(".", ",", ";", ":", "!", "?"), 5).otherwise(6)
    )


def with_features(rows: DataFrame) -> DataFrame:
    """Add ``features``: format and context of the span."""
    span, digits = F.col("span"), _digits(F.col("span"))
    count = lambda pattern: F.regexp_count(span, F.lit(pattern))
    groups = F.split(span, "[^0-9A-Za-z]+")
    sizes = F.transform(groups, lambda g: F.length(g))
    numbers = F.transform(groups, lambda g: F.when(g.rlike("^[0-9]{1,9}$"), g.cast("int")).otherwise(-1))
    columns = {
        "kind": F.col("kind"),
        "length": F.length(span),
        "digits": F.length(digits),
        "letters": count(r"\p{L}"),
        "blanks": count(r"\s"),
        "dashes": count("-"),
        "dots": count(r"\."),
        "brackets": count(r"[()\[\]]"),
        "signs": count("[@+]"),
        "others": count(r"[^\p{L}0-9\s.()\[\]@+-]"),
        "plus": span.startswith("+"),
        "groups": F.size(groups),
        "longest": F.array_max(sizes),
        "last": F.element_at(sizes, -1),
        "largest": F.array_max(numbers),
        "luhn": _luhn(digits),
        "first": F.when(digits != "", F.substr(digits, F.lit(1), F.lit(1)).cast("int")).otherwise(-1),
        "left": _beside(F.right("before", F.lit(1))),
        "right": _beside(F.left("after", F.lit(1))),
        "named": F.col("before").rlike(_KEYWORDS),
    }
    named = {f"__{k}": F.coalesce(v.cast("double"), F.lit(-1.0)) for k, v in columns.items()}
    out = VectorAssembler(inputCols=list(named), outputCol="features").transform(rows.withColumns(named))
    return out.drop(*named)


def _kept_out() -> Column:
    return F.pmod(F.xxhash64("span", "before", "after"), F.lit(5)) == 0


def fit(rows: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, seed: int = 42):
    """Boosted trees on at most ``sample`` rows of each run's hash order; None where one of the two classes is missing."""
    rows = rows.where(F.col("labelled") & ~_kept_out()).select(F.col("base").cast("double").alias("label"), "features", F.xxhash64("span", "before", "after", "kind", F.lit(seed)).alias("order"))
    half = sample // 2
    drawn = reduce(DataFrame.unionByName, [rows.where(F.col("label") == y).orderBy("order").limit(sample) for y in (0.0, 1.0)])
    place = F.row_number().over(W.partitionBy("label").orderBy("order"))
    # What one class lacks of its half the other one may take. At most two times ``sample`` rows get here.
    sizes = F.min("all").over(W.partitionBy())
    drawn = drawn.withColumns({"place": place, "all": F.count("*").over(W.partitionBy("label"))})
    drawn = drawn.withColumn("fewer", sizes).where(F.col("place") <= F.greatest(F.lit(half), sample - F.col("fewer")))
    drawn = stored(drawn.select("label", "features", "order").coalesce(1).sortWithinPartitions("order", "label"), "sample")
    if drawn.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=seed).fit(drawn)


def scored(rows: DataFrame, model) -> DataFrame:
    """Rows with the probability ``score`` of looking like a base span."""
    out = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def thresholds(rows: DataFrame, precision: float = PRECISION) -> DataFrame:
    """(kind, least): the lowest score, in steps, above which the share of base spans among kept-out rows is ``precision``."""
    step = F.floor(F.col("score") * STEPS).cast("int").alias("step")
    sums = rows.where(F.col("labelled") & _kept_out()).groupBy("kind", step).agg(F.count("*").alias("n"), F.sum(F.col("base").cast("long")).alias("right"))
    above = W.partitionBy("kind").orderBy(F.desc("step"))
    # At most STEPS + 1 rows of each kind.
    sums = sums.withColumn("share", F.sum("right").over(above) / F.sum("n").over(above))
    return sums.where((F.col("share") >= precision) & (F.col("step") >= STEPS // 2)).groupBy("kind").agg((F.min("step") / STEPS).alias("least"))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """One row per document: doc_id, text_sha256 and ``spans``, by start, kind and end: (start, kind, end, base), end exclusive."""
    matches = _matches(docs, text, doc_id)
    rows = stored(with_features(candidates(matches)), "candidates")
    picked = rows.where("base").select("row", "start", "kind", "end", "base")
    model = fit(rows, sample)
    if model is not None:
        judged = stored(scored(rows, model), "scored")
        least = F.broadcast(thresholds(judged, precision))  # at most one row of each kind
        more = judged.where("not base").join(least, "kind").where("score >= least").select("row", "start", "kind", "end", "base")
        # A span inside a base span adds nothing.
        order = W.partitionBy("row").orderBy("start", F.desc("base")).rowsBetween(W.unboundedPreceding, W.currentRow)
        both = picked.unionByName(more).withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(order))
        picked = both.where(F.col("base") | F.col("reach").isNull() | (F.col("reach") < F.col("end"))).drop("reach")
    spans = picked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("spans"))
    out = matches.select("row", "doc_id", "text_sha256").join(spans, "row", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean>>")
    return out.select("doc_id", "text_sha256", F.coalesce("spans", none).alias("spans"))


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """What `find` found, as counts of base spans by kind, a digest of the base spans and the list of all."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _of_kind(i))).cast("long").alias(f"n_{name}") for i, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; spans that overlap become one, of the first one's kind.

    A null text stays null.
    """
    kept = found.where(F.size("spans") > 0).groupBy("doc_id", "text_sha256").agg(F.first("spans").alias("__spans"))
    kept = kept.withColumnsRenamed({"doc_id": "__doc", "text_sha256": "__sha"})
    mine = docs.withColumns({"__doc": F.col(f"`{doc_id}`"), "__sha": F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)})
    both = joined(mine, kept, ["__doc", "__sha"], "left")
    names, whole = F.array(*[F.lit(f"[{k}]") for k in KINDS]), F.col(f"`{text}`")

    def add(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        between = F.substr(whole, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        out = F.when(fresh, F.concat(state["out"], between, F.element_at(names, s["kind"] + 1))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate("__spans", start, add, lambda s: F.concat(s["out"], F.substr(whole, (s["at"] + 1).cast("int"), F.length(whole))))
    return both.withColumn(text, F.when(F.col("__spans").isNull(), whole).otherwise(done)).select(*docs.columns)
