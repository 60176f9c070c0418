"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > j) = sigmoid(w.x - c_j) with one weight vector for all thresholds c_0 < c_1. Features are hashed words: each
distinct word, and each word beginning of 4 to 6 letters, adds its log ratio of toxic to clean documents, counted over
all labelled documents. The result is the expected severity, the sum over j of P(grade > j).

The labels only tell toxic from clean. A toxic document gets grade 2 if at least half of the toxic ones have no higher
number of words that point to toxicity, else grade 1; clean documents get 0.

The counts cover every labelled document. The weights are fitted on at most ``sample`` labelled documents, so the driver
holds a bounded table. Toxic and clean ones are drawn apart, those with the smallest hash of doc_id: each class has half
of the sample, and what one class cannot fill goes to the other, so rare toxic labels are never drowned. Words that the
counts select but no drawn document holds keep weight 1, the one that the fit starts from.

Defined cases: null, empty and wordless texts have no feature and get the severity of the thresholds alone, which is
below any sensible limit; labels without a grade or a document are ignored, a doc_id labelled twice counts as toxic if
one label says so; without toxic labels every severity is 0; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, send, stored

BUCKETS = 1 << 18
SAMPLE = 20_000
GRADES = 3
# Least first threshold: a text without features has a probability of at most 1 / (1 + e^2) of being toxic.
BASE = 2.0
# Documents with at least this expected severity count as toxic.
LIMIT = 0.7
# A word points to toxicity if its log ratio is above this.
POINTS = 1.5
# Lengths of word beginnings that count as features of their own, for languages that add endings to a stem.
STEMS = (4, 5, 6)
EDGES = ".,;:!?\"'()[]{}*&%$#|"
# A feature needs so many labelled documents, and a share of toxic ones so many standard deviations off the mean.
LEAST, DEVIATIONS = 8, 4.0
# Features of the sample that a step of the fit looks at together; only their buckets are held for all rows.
BLOCK = 1 << 16


class Words:
    """Hashed words of whole texts; the buckets of a word are found once per worker."""

    def __init__(self):
        self.place, self.rows = {}, np.empty((1 << 16, 1 + len(STEMS)), np.int32)

    def _add(self, word: str) -> int:
        at = len(self.place)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        bare = word.strip(EDGES)
        stems = [bare[:k] + "*" if len(bare) >= k else bare for k in STEMS]
        self.rows[at] = [crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (bare, *stems)]
        self.place[word] = at
        return at

    def buckets(self, text: str | None) -> np.ndarray:
        """Sorted distinct buckets of the words and word beginnings of a text."""
        words = set(text.casefold().split()) if text else ()
        if not words:
            return np.empty(0, np.int32)
        if len(self.place) > 400_000:
            self.place.clear()
        place, add = self.place, self._add
        at = [place[w] if w in place else add(w) for w in words]
        return np.unique(self.rows[at])


@lean
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, sums = Words(), np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            sums[toxic][words.buckets(text.as_py())] += 1
    at = np.nonzero(sums.sum(axis=0))[0]
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["at", "clean", "toxic"])


def _features(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [words.buckets(t.as_py()) for t in batch.column(0)]
            found = [at[ratio[at] != 0] for at in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *batch.columns[1:]], names=["at", "toxic", "of"])

    return lean(run)


@dataclass
class Severity:
    """Word log ratios, one weight per word, and ordered thresholds."""

    ratio: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray

    def raw(self, at: np.ndarray) -> float:
        return float((self.ratio[at] * self.weight[at]).sum())

    def expected(self, score: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts, -40, 40)))).sum(axis=1)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, ratio: np.ndarray, rounds: int = 300, ridge: float = 0.01, rate: float = 0.05) -> Severity:
    """Maximum likelihood with Adam steps over the whole sample; thresholds keep their order by positive gaps."""
    at = np.concatenate(rows).astype(np.int32, copy=False) if rows else np.empty(0, np.int32)
    size = np.array([len(r) for r in rows], np.int64)
    ends = np.cumsum(size)
    seen = np.zeros(len(ratio), bool)
    seen[at] = True
    used = np.flatnonzero(seen)
    place = np.zeros(len(ratio), np.int32)
    place[used] = np.arange(len(used))
    local, value = place[at], ratio[used]
    del at
    # Whole rows, about BLOCK features each time.
    edges = np.flatnonzero(np.diff((ends - size) // BLOCK)) + 1
    blocks = [(a, b, ends[a] - size[a], ends[b - 1]) for a, b in zip([0, *edges], [*edges, len(rows)]) if b > a]
    levels = int(grades.max()) if len(grades) else 0
    if not levels:
        return Severity(ratio, np.zeros_like(ratio), np.full(GRADES - 1, 40.0))
    w = np.concatenate([np.ones(len(used)), [1.0], np.zeros(levels - 1)])
    above = grades[:, None] > np.arange(levels)
    # The few toxic rows weigh as much as the many clean ones.
    pull = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        cuts = w[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(w[len(used) + 1 :]))])
        score, worth = np.empty(len(rows)), value * w[: len(used)]
        for a, b, lo, hi in blocks:
            score[a:b] = np.bincount(np.repeat(np.arange(b - a), size[a:b]), worth[local[lo:hi]], minlength=b - a)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40)))
        # P(grade = g) is a difference of neighbouring curves; its log-likelihood has this slope in the score.
        upper = np.concatenate([np.ones((len(rows), 1)), p], axis=1)
        lower = np.concatenate([p, np.zeros((len(rows), 1))], axis=1)
        pick = np.arange(len(rows)), grades
        mass = np.maximum(upper[pick] - lower[pick], 1e-12)
        du, dl = upper[pick] * (1 - upper[pick]), lower[pick] * (1 - lower[pick])
        slope = -pull * (du - dl) / mass
        g = np.zeros_like(w)
        for a, b, lo, hi in blocks:
            np.add.at(g, local[lo:hi], value[local[lo:hi]] * np.repeat(slope[a:b], size[a:b]))
        g[: len(used)] += ridge * w[: len(used)] / len(used)
        per_cut = np.zeros((len(rows), levels))
        has_up, has_low = grades > 0, grades < levels
        per_cut[has_up, grades[has_up] - 1] += (pull * du / mass)[has_up]
        per_cut[has_low, grades[has_low]] -= (pull * dl / mass)[has_low]
        each = per_cut.sum(axis=0)
        g[len(used)] = each.sum()
        gaps = np.exp(w[len(used) + 1 :])
        for j in range(levels - 1):
            g[len(used) + 1 + j] = each[j + 1 :].sum() * gaps[j]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weight = (ratio != 0).astype(float)
    weight[used] = w[: len(used)]
    cuts = w[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(w[len(used) + 1 :]))])
    return Severity(ratio, weight, cuts)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> Severity:
    """Fit the grades of the labelled documents among ``docs``."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__of"))
    known = stored(known.agg((F.max("toxic") > 0).cast("int").alias("__toxic")), "known")
    mine = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    # Labels without a document have no part in the sample either.
    known = stored(mine.join(send(known, 12), F.col("__id") == F.col("__of")).select("__of", "__toxic").distinct(), "held")
    rows = mine.join(send(known, 12), F.col("__id") == F.col("__of")).select("__text", "__toxic")
    counts = rows.mapInArrow(_counted, "at long, clean long, toxic long").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = {r[0]: r[1] for r in rows.groupBy("__toxic").agg(F.count("*")).collect()}
    good, bad = total.get(0, 0), total.get(1, 0)
    ratio = np.zeros(BUCKETS)
    if not bad:
        return Severity(ratio, ratio, np.full(GRADES - 1, 40.0))
    # Words whose share among toxic documents is within what chance gives have no say; the others are few, and never
    # more than there are buckets.
    p, n = bad / (good + bad), F.col("clean") + F.col("toxic")
    chance = F.abs(F.col("toxic") - n * p) / F.sqrt(n * (p * (1 - p)) + 1e-9)
    told = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    for r in counts.where((n >= LEAST) & (chance >= DEVIATIONS)).select("at", told.alias("ratio")).collect():
        ratio[r["at"]] = r["ratio"]
    # The sample is bounded by its parameter, so its keys may go to every executor.
    keys = {r[0]: r[1] for r in known.groupBy("__toxic").agg(F.count("*")).collect()}
    most = min(keys[1], max(1, sample // 2, sample - keys.get(0, 0)))
    first = known.orderBy(F.xxhash64("__of"), "__of")
    drawn = F.broadcast(first.where("__toxic = 1").limit(most).unionByName(first.where("__toxic = 0").limit(sample - most)))
    part = mine.join(drawn, F.col("__id") == F.col("__of")).select("__text", "__toxic", "__of")
    part = part.mapInArrow(_features(ratio), f"at array<int>, toxic int, of {part.schema['__of'].dataType.simpleString()}")
    # One row for each drawn doc_id, however many rows share it, so the bound holds for rows too.
    part = part.groupBy("of").agg(F.min("at").alias("at"), F.min("toxic").alias("toxic")).toPandas().sort_values("of")
    sets = [np.asarray(a, np.int32) for a in part["at"]]
    toxic = part["toxic"].to_numpy().astype(np.int64)
    del part
    points = np.array([(ratio[s] > POINTS).sum() for s in sets])
    middle = np.median(points[toxic == 1]) if (toxic == 1).any() else 0.0
    model = fit_ordinal(sets, toxic + ((toxic == 1) & (points >= middle)), ratio)
    # Balanced classes put the thresholds low when few words tell anything: a text without features stays clean.
    model.cuts = model.cuts + max(0.0, BASE - model.cuts[0])
    return model


def _scored(model: Severity):
    weight, cuts = (model.ratio * model.weight).astype(np.float32), model.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            score = np.array([weight[words.buckets(t.as_py())].sum(dtype=np.float64) for t in batch.column(batch.num_columns - 1)])
            severity = (1 / (1 + np.exp(-np.clip(score.reshape(-1, 1) - cuts, -40, 40)))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(severity)], names=[*batch.schema.names[:-1], "__severity"])

    return lean(run)


def with_severity(docs: DataFrame, model: Severity, text: str = "text", name: str = "severity", keep: list[str] | None = None) -> DataFrame:
    """Add the expected severity, 0 to 2, to every document; ``keep`` names the columns wanted besides."""
    keep = docs.columns if keep is None else keep
    schema = docs.select(*keep).schema.add("__severity", "double")
    out = docs.select(*keep, F.col(f"`{text}`").alias("__text")).mapInArrow(_scored(model), schema)
    return out.withColumnRenamed("__severity", name)
