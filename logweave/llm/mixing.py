"""Mixing to target weights with soft membership, in DataFrame functions only.

1. *Classifier.* From a labelled table (doc_id, domain) a naive Bayes over words is fitted on a bounded sample. It
   gives each document a posterior p[d] of each domain. The log-likelihood of a text of n words is divided by
   sqrt(n), so that long texts keep soft memberships.
2. *Rates.* Each document i with share a_i of all tokens gets a rate w_i >= 0. Projected gradient descent fits the
   least squares of r = sum_i a_i w_i p_i - t, so that the expected domain token totals sum_i a_i w_i p_i match the
   target shares t. The squares are weighted by M^-1, M = sum a_i p_i p_i' over the documents whose rate is above 0, so
   a step of length 1 is right; it is halved while r does not shrink. The steps are summed from the start and projected at
   the end (lazy projection): g <- g + M^-1 r, w_i = max(0, 1 - p_i' g). Projecting each step by itself would end at any
   rates that match the totals, and would need the rates of all documents as state; this finds those that are nearest to
   1, so documents are not given up without need, and an iteration is one distributed sum that returns a number a domain
   and a number a pair of domains, as a document's rate follows from its posterior and g. The reached shares are
   returned; where no rates match the targets (``TOLERANCE``) the best that were found are, with a warning.
   A document whose posterior holds more of an unwanted domain than the target allows gets a low rate or none. Short
   texts that tell nothing have the prior as posterior, so they go where a domain's prior is well above its target: on few
   labels more rows are lost than on many, though the token total stays.
3. *Copies.* A document appears floor(w_i) times, and once more if a hash of its id falls below the rest.

Edge cases: null and empty texts have no tokens, the prior as posterior, and rate as others; null ids or
domains are not learnt; a domain without tokens can't be reached and its target is shared among the others; rows of one id
count as one document; an empty table gives an empty result; equal hashes need no rule; other columns pass through.
"""

from __future__ import annotations

import warnings
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Labelled rows of each domain that training reads, in expectation; words of the model: both bound what is broadcast.
TRAIN_ROWS_PER_DOMAIN, VOCABULARY = 1500, 20_000
#: A word must occur so often in the sample to enter the vocabulary; others are one unknown word.
MIN_COUNT = 3
MAX_STEPS, TOLERANCE = 60, 1e-6


def _words(text: Column) -> Column:
    """Lower-case words between white space; blank ends are included and are left out after the explosion."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+")


class DomainModel:
    """Words with one log-probability a domain (``table``), those of an unknown word, and log priors."""

    def __init__(self, domains: list[str], table: DataFrame, unknown: list[float], prior: list[float]):
        self.domains, self.table, self.unknown, self.prior = domains, table, unknown, prior


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], rows_per_domain: int = TRAIN_ROWS_PER_DOMAIN) -> DomainModel:
    """Fit on a bounded sample of ``labels(doc_id, domain)``; the draw is a hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for d in domains:
        rate = F.when(F.col("domain") == d, min(1.0, rows_per_domain / max(1, sizes.get(d, 0)))).otherwise(rate)
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000).select("doc_id", "domain")
    words = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("domain", F.explode(_words(F.col("text"))).alias("word")).where("word != ''")
    counts = written(words.groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)]), "word-counts")
    total = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(len(domains))]).first()
    vocabulary = counts.where(F.col("n") >= MIN_COUNT).orderBy(F.desc("n"), "word").limit(VOCABULARY)
    vocabulary = written(vocabulary, "vocabulary")
    inside = vocabulary.agg(F.count("*"), *[F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(len(domains))]).first()
    size = inside[0] + 1
    smooth = [log(t + 0.5 * size) for t in total]
    table = vocabulary.select("word", *[(F.log(F.col(f"c{k}") + 0.5) - smooth[k]).alias(f"l{k}") for k in range(len(domains))])
    unknown = [log(t - i + 0.5) - s for t, i, s in zip(total, inside[1:], smooth)]
    labelled = sum(sizes.values()) + len(domains)
    return DomainModel(domains, table, unknown, [log((sizes.get(d, 0) + 1) / labelled) for d in domains])


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """(doc_id, n_tokens, p array<double>) of each id; the vocabulary (VOCABULARY words at most) is broadcast."""
    ids = range(len(model.domains))
    words = docs.select("doc_id", F.explode(_words(F.col("text"))).alias("word"))
    scored = words.join(F.broadcast(model.table), "word", "left")
    blank = F.col("word") == ""
    sums = scored.groupBy("doc_id").agg(F.count_if(~blank).alias("n_tokens"), *[F.sum(F.when(blank, 0.0).otherwise(F.coalesce(f"l{k}", F.lit(model.unknown[k])))).alias(f"s{k}") for k in ids])
    logit = [F.col(f"s{k}") / F.sqrt(F.greatest("n_tokens", F.lit(1))) + model.prior[k] for k in ids]
    shifted = sums.select("doc_id", "n_tokens", *[x.alias(f"x{k}") for k, x in enumerate(logit)]).withColumn("top", F.greatest(*[f"x{k}" for k in ids]) if len(model.domains) > 1 else F.col("x0"))
    weights = shifted.select("doc_id", "n_tokens", *[F.exp(F.col(f"x{k}") - F.col("top")).alias(f"e{k}") for k in ids])
    whole = sum((F.col(f"e{k}") for k in ids), F.lit(0.0))
    return weights.select("doc_id", "n_tokens", F.array(*[F.col(f"e{k}") / whole for k in ids]).alias("p"))


def rate_column(pull: list[float]) -> Column:
    """A document's rate under the summed steps ``pull``, from its posterior ``p``."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.lit(float(x)) * F.col("p")[k] for k, x in enumerate(pull)), F.lit(0.0)))


def fit_rates(members: DataFrame, targets: list[float]) -> tuple[DataFrame, list[float]]:
    """``members`` with ``rate``, and the reached shares; ``targets`` are shares of the present token total."""
    ids = range(len(targets))
    n = F.col("n_tokens").cast("double")
    pairs = [(k, j) for k in ids for j in ids if k <= j]

    def sums(pull: list[float]) -> tuple[float, np.ndarray, np.ndarray]:
        """All tokens, the totals by domain, and M."""
        rows = members.select("n_tokens", "p", rate_column(pull).alias("w"))
        free = F.when(F.col("w") > 0, n).otherwise(0.0)
        row = rows.agg(F.sum(n), *[F.sum(n * F.col("w") * F.col("p")[k]) for k in ids], *[F.sum(free * F.col("p")[k] * F.col("p")[j]) for k, j in pairs]).first()
        matrix = np.zeros((len(targets), len(targets)))
        for (k, j), x in zip(pairs, row[1 + len(targets) :]):
            matrix[k, j] = matrix[j, k] = x or 0.0
        return row[0] or 0.0, np.array([x or 0.0 for x in row[1 : 1 + len(targets)]]), matrix

    pull = np.zeros(len(targets))
    total, got, matrix = sums(pull.tolist())
    if not total:
        return members.withColumn("rate", F.lit(1.0)), [0.0] * len(targets)
    got = got / total
    goal = np.where(got > 0, targets, 0.0)
    goal = goal / goal.sum() if goal.sum() > 0 else got
    best, step, length = (np.abs(got - goal).max(), pull, got), np.linalg.pinv(matrix / total) @ (got - goal), 1.0
    for _ in range(MAX_STEPS):
        if best[0] < TOLERANCE:
            break
        tried = best[1] + length * step
        _, got, matrix = sums(tried.tolist())
        got = got / total
        off = np.abs(got - goal).max()
        if off < best[0]:
            best, step, length = (off, tried, got), np.linalg.pinv(matrix / total) @ (got - goal), min(1.0, 2 * length)
        else:
            length /= 2
    if best[0] >= TOLERANCE:
        warnings.warn(f"target shares {goal.tolist()} are not met: reached {best[2].tolist()}", stacklevel=2)
    return members.withColumn("rate", rate_column(best[1].tolist())), best[2].tolist()


def copies(rate: Column, doc_id: Column) -> Column:
    """How often a document appears: the whole part of its rate, and one more by a hash of its id."""
    unit = F.pmod(F.xxhash64(doc_id, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(doc_id, n_tokens, p, rate, copies, reached) of each id, for target shares by domain; ``reached`` is what all rates give together."""
    domains = sorted(targets)
    members = written(posteriors(docs, fit(docs, labels, domains)), "members")
    rated, reached = fit_rates(members, [targets[d] for d in domains])
    return rated.withColumns({"copies": copies(F.col("rate"), F.col("doc_id")), "reached": F.array(*[F.lit(float(x)) for x in reached])})


def apply_copies(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as ``rated(doc_id, copies)`` says; same columns."""
    names = docs.columns
    by_id = rated.select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies"))
    joined = docs.join(by_id, F.col("doc_id").eqNullSafe(F.col("_id"))).where("_copies > 0")
    return joined.select(*names, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*names)
