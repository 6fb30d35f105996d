"""Mixing of domains to target weights by rates of single documents, in DataFrame functions only.

A labelled table (text, domain) teaches a naive Bayes classifier over hashed words. It gives every document a
posterior over the domains, so a document belongs to each of them in part. Rates say how often a document is to
be used. They are fitted so that the expected tokens of every domain, summed over all documents as tokens x rate x
posterior, come to a target: projected gradient descent with momentum on the squared misses, with rates kept at or
above their least value. Misses are measured by the inverse of the domains' joint tokens (tokens x posterior x
posterior), which undoes what mixed posteriors share, so a rare domain is fitted as fast as a large one. It goes on
until the targets are met or nothing more is gained; what each domain then has is reported against its target.

A step changes a rate by the document's posterior times one number per domain. The rate is therefore a fold over
the numbers of the steps so far: a round is one pass of sums over a narrow table, and nothing is shuffled but one
row of sums per task.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import held_out
from arborlake.session import cut_lineage

BUCKETS = 8192  # hashed words of the classifier
PER_DOMAIN = 2000  # labelled rows of a domain, about: the bound of the fitted sample
EVIDENCE = 32  # words whose weight a text's mean likelihood carries at most
POWER = 0.7  # default targets: token shares to this power
ROUNDS = 400
CLOSE = 1e-4  # relative miss that ends the rounds
GAIN = 1e-5  # part of the squared misses; rounds that gain less in a row end the fit
IDLE = 4  # so many of them
WRITTEN = 8  # rounds between two tables of rates
UNIT = 1 << 30

log = logging.getLogger(__name__)


def exploded(text: Column) -> Column:
    """Lower-cased words with their position; one row without a word for a null text."""
    return F.posexplode_outer(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+")).alias("place", "word")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _chance(*columns: Column) -> Column:
    """A number in [0, 1) that a row keeps over all runs."""
    return F.pmod(F.xxhash64(*columns), F.lit(UNIT)) / float(UNIT)


def _constant(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


@dataclass(frozen=True)
class DomainModel:
    domains: list[str]
    prior: list[float]
    words: list[list[float]]  # log probability of each bucket, per domain

    def posterior(self, tokens: Column, sums: list[Column]) -> Column:
        """Array of the domains' probabilities from a text's number of words and summed log probabilities."""
        weight = F.when(tokens > 0, F.least(tokens, F.lit(EVIDENCE)) / tokens).otherwise(0.0)
        scores = [F.lit(math.log(p)) + F.coalesce(s, F.lit(0.0)) * weight for p, s in zip(self.prior, sums)]
        raw = F.array(*scores)
        grown = F.transform(raw, lambda s: F.exp(s - F.array_max(raw)))
        return F.transform(grown, lambda e: e / F.aggregate(grown, F.lit(0.0), lambda a, x: a + x))


def fit_domains(labelled: DataFrame, key: Column, per_domain: int = PER_DOMAIN) -> DomainModel:
    """The classifier from columns ``text, domain``; rows without a domain teach nothing.

    About ``per_domain`` rows of each domain are used, chosen by the hash of ``key`` at a rate that follows from
    the domain's size. Without any domain there is the single domain ``all``.
    """
    known = labelled.filter("domain is not null")
    sizes = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}  # one row per domain
    domains = sorted(sizes)
    if not domains:
        return DomainModel(["all"], [1.0], [[0.0] * BUCKETS])
    rate = F.create_map(*(F.lit(x) for d in domains for x in (d, min(1.0, per_domain / sizes[d]))))
    taken = known.filter(_chance(key) < F.get(F.array(F.element_at(rate, F.col("domain"))), F.lit(0)))
    counts = {d: [0.1] * BUCKETS for d in domains}
    seen = taken.select("domain", exploded(F.col("text"))).filter("word <> ''").groupBy("domain", bucket(F.col("word")).alias("bucket")).count()
    for r in seen.collect():  # at most domains x buckets
        counts[r.domain][r.bucket] += r["count"]
    total = sum(sizes.values())
    logs = [[math.log(c / sum(counts[d])) for c in counts[d]] for d in domains]
    return DomainModel(domains, [sizes[d] / total for d in domains], [[round(x, 6) for x in row] for row in logs])


@dataclass
class Rates:
    """Fitted rates as the list of steps that lead to them: the momentum and one number a domain."""

    domains: list[str]
    targets: list[float]
    least: float
    steps: list[list[float]] = field(default_factory=list)
    tokens: list[float] = field(default_factory=list)  # before
    totals: list[float] = field(default_factory=list)  # after

    def state(self, posterior: Column, start: Column | None = None, since: int = 0) -> Column:
        """``rate, last`` after all steps, or from ``start`` on after those ``since`` a step."""
        if start is None:
            first = F.greatest(F.lit(float(self.least)), F.lit(1.0))
            start = F.struct(first.alias("rate"), first.alias("last"))
        if since == len(self.steps):
            return start
        steps = F.array(*(F.array(*map(F.lit, step)) for step in self.steps[since:]))

        def move(own: Column, step: Column) -> Column:
            ahead = own["rate"] + F.get(step, F.lit(0)) * (own["rate"] - own["last"])
            slope = reduce(lambda a, b: a + b, (F.get(posterior, F.lit(k)) * F.get(step, F.lit(k + 1)) for k in range(len(self.domains))))
            return F.struct(F.greatest(F.lit(float(self.least)), ahead - slope).alias("rate"), own["rate"].alias("last"))

        return F.aggregate(steps, start, move)

    def rate(self, posterior: Column) -> Column:
        return self.state(posterior)["rate"]

    @property
    def miss(self) -> float:
        return max((abs(s - t) / t for s, t in zip(self.totals, self.targets) if t > 0), default=0.0)

    def report(self, spark: SparkSession) -> DataFrame:
        """``domain, tokens, target, total``: expected tokens before, wanted and after."""
        return spark.createDataFrame([*zip(self.domains, self.tokens, self.targets, self.totals)], "domain string, tokens double, target double, total double")


def default_targets(sums: list[float], power: float = POWER) -> list[float]:
    """Shares to the power, scaled so that the domain nearest to having enough keeps just what it has."""
    weights = [max(s, 0.0) ** power for s in sums]
    scale = max((s / w for s, w in zip(sums, weights) if w > 0), default=0.0)
    return [w * scale for w in weights]


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float] | None = None, least: float = 0.0, rounds: int = ROUNDS) -> Rates:
    """Rates for rows ``tokens, posterior``.

    ``targets`` are wanted tokens by domain (missing ones: none wanted); by default those of ``default_targets``.
    The rounds end when every domain is within ``CLOSE`` of its target, or at the optimum, where several rounds in a
    row gain next to nothing. Momentum starts anew when the misses grow. Every few rounds the rates are written, so
    that a round folds a few steps only.
    """
    def sums(rate: Column) -> list[float]:
        own = [F.sum(F.col("tokens") * F.col("_rate") * F.get("posterior", F.lit(k))).alias(f"s{k}") for k in range(len(domains))]
        return [float(x or 0.0) for x in members.withColumn("_rate", rate).agg(*own).first()]

    pairs = [(k, j) for k in range(len(domains)) for j in range(k + 1)]
    joint = members.agg(*(F.sum(F.col("tokens") * F.get("posterior", F.lit(k)) * F.get("posterior", F.lit(j))) for k, j in pairs)).first()
    shared = np.zeros((len(domains), len(domains)))
    for (k, j), value in zip(pairs, joint):
        shared[k, j] = shared[j, k] = value or 0.0
    start = sums(F.lit(1.0))
    wanted = default_targets(start) if targets is None else [float(targets.get(d, 0.0)) for d in domains]
    # in this measure the curvature is one; a little is added for domains that no document tells apart
    shared += np.eye(len(domains)) * 1e-9 * (sum(start) + 1)

    def misses(totals: list[float]) -> list[float]:
        return np.linalg.solve(shared, np.subtract(totals, wanted)).tolist()

    def cost(totals: list[float]) -> float:
        return float(np.subtract(totals, wanted) @ misses(totals))

    fitted = Rates(domains, wanted, least, tokens=start)
    fitted.totals = start if least <= 1.0 else sums(F.lit(float(least)))
    before, pace, best, idle, written, current = fitted.totals, 1.0, cost(fitted.totals), 0, 0, None
    for _ in range(rounds):
        if fitted.miss < CLOSE or idle == IDLE:
            break
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        push, pace = (pace - 1) / faster, faster
        # totals are linear in the rates, so those of the point ahead need no pass
        ahead = [s + push * (s - b) for s, b in zip(fitted.totals, before)]
        fitted.steps.append([push, *misses(ahead)])
        if len(fitted.steps) - written == WRITTEN:
            members = cut_lineage(members.withColumn("state", fitted.state(F.col("posterior"), current, written)))
            written, current = len(fitted.steps), F.col("state")
        before, fitted.totals = fitted.totals, sums(fitted.state(F.col("posterior"), current, written)["rate"])
        new = cost(fitted.totals)
        if new > cost(before):
            pace = 1.0
        idle = idle + 1 if new > best * (1 - GAIN) else 0
        best = min(best, new)
    return fitted


def memberships(documents: DataFrame, model: DomainModel) -> DataFrame:
    """``doc_id, text_hash, rows, tokens, posterior``: one row for each different document.

    Words are summed where they are read, so what is shuffled is one row of sums per document.
    """
    # the hash is taken below the explode, or every word would take it again
    stamped = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    spelled = stamped.select("doc_id", "text_hash", exploded(F.col("text")))
    real = F.col("word") != ""
    marked = spelled.withColumn("bucket", F.when(real, bucket(F.col("word"))))
    sums = [F.sum(F.get(_constant(t), F.col("bucket"))).alias(f"s{k}") for k, t in enumerate(model.words)]
    rows = F.sum(F.when(F.coalesce("place", F.lit(0)) == 0, 1).otherwise(0)).alias("rows")
    summed = marked.groupBy("doc_id", "text_hash").agg(rows, F.count("bucket").alias("all"), *sums)
    own = [F.col(f"s{k}") / F.col("rows") for k in range(len(model.domains))]
    tokens = F.floor(F.col("all") / F.col("rows"))
    return summed.select("doc_id", "text_hash", "rows", tokens.alias("tokens"), model.posterior(tokens, own).alias("posterior"))


def mixed(documents: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None, least: float = 0.0) -> tuple[DataFrame, Rates]:
    """``doc_id, text_hash, rows, tokens, posterior, rate, copies`` for each different document, and the fit.

    The labelled table is the documents that have a ``domain``, outside the held-out fold. Copies are the rate's
    whole part and one more with its fraction as chance, the same in every run. A null or empty text has no
    tokens and the prior as posterior. Repeated rows share one entry, which counts them.
    """
    labelled = documents.filter(~held_out()).select("doc_id", "text", F.col(domain).alias("domain"))
    model = fit_domains(labelled, F.col("doc_id"))
    members = cut_lineage(memberships(documents, model))
    fitted = fit_rates(members.select((F.col("tokens") * F.col("rows")).alias("tokens"), "posterior"), model.domains, targets, least)
    rated = members.withColumn("rate", fitted.rate(F.col("posterior")))
    more = _chance(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit("copies")) < F.col("rate") - F.floor("rate")
    return rated.withColumn("copies", (F.floor("rate") + F.when(more, 1).otherwise(0)).cast("int")), fitted


def mixing_rates(documents: DataFrame, domain: str = "lang") -> DataFrame:
    """``doc_id, n_tokens, posterior, rate, copies, miss`` for every row, the last the largest relative miss of a
    target that is left. An empty table gives an empty result."""
    rows, fitted = mixed(documents.select("doc_id", "text", domain), domain)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_time")
    return rows.select("doc_id", F.col("tokens").alias("n_tokens"), "posterior", "rate", "copies", F.lit(fitted.miss).alias("miss"), again).drop("_time")


def repeat_to_targets(documents: DataFrame, domain: str = "lang") -> DataFrame:
    """Every document as often as its rate says, at least once: scarce domains are repeated, nothing is dropped."""
    rows, fitted = mixed(documents, domain, least=1.0)
    for name, had, target, total in zip(fitted.domains, fitted.tokens, fitted.targets, fitted.totals):
        log.info("domain %s: %.0f tokens, target %.0f, mixed %.0f", name, had, target, total)
    copies = rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("copies").alias("_copies"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    times = F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_time")
    return documents.join(copies, same).select(*documents.columns, times).drop("_time")
