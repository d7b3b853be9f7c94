"""Mixing domains to target weights with soft membership.

A logistic regression over the hashed words that a text has, learned from a labelled table, gives every document the
probability of each domain. Document rates r >= 0 then minimise

    sum over domains d of  (sum_i r_i t_i p_id - w_d B)**2 / N_d

(t white-space tokens, p posteriors, w weights, B the token budget, N the totals at rate 1) by projected gradient
with momentum from r = 1, each document's step divided by its tokens. The budget is the largest for which no wanted domain, one
with at least an even share of the weights, must repeat tokens; a scarcer one of the others gives what it has and
falls short, which is logged. An iteration is one aggregation over all
documents; what passes the driver is one number a domain.

Everything is Spark SQL; the model is literals of ``buckets`` x domains numbers. Training takes at most
``train_rows`` labelled documents, lowest id hash first; totals, posteriors and rates cover all rows.

Cases: null and blank texts have no tokens, the prior as posteriors, and rate as such; rows without id
stay; with no labelled row, or one domain only, posteriors are even over ``domains``; weights need not
sum to one; a weight for which no token is found is left unmet; repeated rows count as often as they
occur; an empty table gives an empty table.
"""

from __future__ import annotations

import logging
import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

BUCKETS, TRAIN_ROWS = 16_384, 20_000
#: The weight of the penalty on absolute coefficients, and passes over the training documents.
PENALTY, PASSES = 3e-4, 30
#: Steps replayed in one expression before the rates are written.
REPLAY = 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \n\t\r]"), lambda w: w != "")


def features(docs: DataFrame, text: Column, buckets: int) -> DataFrame:
    """``docs`` with ``features``: which hashed words the text has, lower-cased and without full stops and commas."""
    split = docs.withColumn("_words", F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,]+"))
    return HashingTF(numFeatures=buckets, binary=True, inputCol="_words", outputCol="features").transform(split).drop("_words")


class Classifier:
    """Domains, those of them that the labels know, and the model of these."""

    def __init__(self, domains: list[str], known: list[str], model: LogisticRegressionModel | None, buckets: int) -> None:
        self.domains, self.known, self.model, self.buckets = domains, known, model, buckets

    def posteriors(self, docs: DataFrame, text: Column) -> DataFrame:
        """``docs`` with ``p``, array<double> over the domains."""
        if self.model is None:
            return docs.withColumn("p", F.array(*[F.lit(1.0 / len(self.domains)) for _ in self.domains]))
        found = self.model.transform(features(docs, text, self.buckets)).withColumn("_p", vector_to_array("probability"))
        p = F.array(*[F.get("_p", F.lit(self.known.index(d))) if d in self.known else F.lit(0.0) for d in self.domains])
        return found.withColumn("p", p).drop("features", "rawPrediction", "probability", "prediction", "_p")


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], train_rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> Classifier:
    """``docs`` (doc_id, text), ``labels`` (doc_id, domain)."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    labelled = known.count()
    if labelled > train_rows:  # a threshold of the hash, so that no task ranks them all; four deviations under the bound
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((train_rows - 4 * math.sqrt(train_rows)) / labelled * (1 << 40)))
    chosen = materialize(known, "chosen")
    sample = docs.join(F.broadcast(chosen), "doc_id")  # about train_rows labels
    sample = materialize(features(sample, F.col("text"), buckets).select("domain", "features"), "sample")
    found = {r[0] for r in sample.select("domain").distinct().collect()}
    there = [d for d in domains if d in found]
    model = None
    if len(there) > 1:
        index = F.array_position(F.array(*[F.lit(d) for d in there]), F.col("domain")) - 1
        model = LogisticRegression(labelCol="label", regParam=PENALTY, elasticNetParam=1.0, maxIter=PASSES, family="multinomial", standardization=False).fit(sample.select(index.cast("double").alias("label"), "features"))
    discard(chosen, sample)
    return Classifier(domains, there, model, buckets)


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the quality and toxic labels."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).filter("domain is not null")


#: Domains of :func:`quality_domains` and their default weights.
WEIGHTS = {"good": 0.92, "plain": 0.07, "toxic": 0.01}


def targets(n: list[float], weights: list[float], upsample: bool = False) -> list[float]:
    """Tokens wanted of each domain, of which there are ``n``. Without ``upsample`` none is asked for more than it has,
    and only wanted domains, those with at least an even share of the weights, bound the budget."""
    k, share = len(weights), [w / sum(weights) for w in weights]
    if upsample:
        return [x * sum(n) for x in share]
    bound = [d for d in range(k) if n[d] > 0 and share[d] > 0]
    wanted = [d for d in bound if share[d] * k >= 1 - 1e-9] or bound
    budget = min((n[d] / share[d] for d in wanted), default=sum(n))
    return [min(share[d] * budget, n[d]) for d in range(k)]


def unmet(n: list[float], weights: list[float]) -> dict[int, tuple[float, float]]:
    """Domain -> (share of the tokens that it gets, share that its weight asks for), where it gets less."""
    target = targets(n, weights)
    got = [t / (sum(target) or 1.0) for t in target]
    return {d: (got[d], w / sum(weights)) for d, w in enumerate(weights) if got[d] < 0.999 * w / sum(weights)}


def fit_rates(members: DataFrame, weights: list[float], upsample: bool = False, tolerance: float = 1e-4, max_steps: int = 80) -> DataFrame:
    """``members`` (tokens, p array<double>, ...) with a column ``rate``. The budget is the largest that no wanted domain
    must repeat tokens for, see :func:`targets`; with ``upsample`` it is all tokens."""
    k = len(weights)
    total = members.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(d))).alias(f"n{d}") for d in range(k)]).first()
    n = [x or 0.0 for x in total]
    usable = [d for d in range(k) if n[d] > 0]
    if not usable:
        return members.withColumn("rate", F.lit(1.0))
    target = targets(n, weights, upsample)
    for d, (got, asked) in ({} if upsample else unmet(n, weights)).items():
        logging.getLogger(__name__).warning("domain %d of %d has too few tokens: %.4f of the mix instead of %.4f", d + 1, k, got, asked)

    def stepped(df: DataFrame, steps: list[tuple[list[float], float]]) -> DataFrame:
        """The steps one after the other: down the gradient from ``look``, then as far again as ``ahead`` says."""
        if not steps:
            return df
        each = F.array(*[F.struct(F.array(*map(F.lit, g)).alias("g"), F.lit(ahead).alias("ahead")) for g, ahead in steps])

        def step(now: Column, s: Column) -> Column:
            move = sum((F.get("p", F.lit(d)) * F.get(s["g"], F.lit(d)) for d in usable), F.lit(0.0))
            rate = F.greatest(F.lit(0.0), now["look"] - move)
            return F.struct(rate.alias("rate"), (rate + s["ahead"] * (rate - now["rate"])).alias("look"))

        return df.withColumn("_s", F.aggregate(each, F.struct("rate", "look"), step)).withColumns({"rate": F.col("_s.rate"), "look": F.col("_s.look")}).drop("_s")

    base, written, steps, pace = members.withColumns({"rate": F.lit(1.0), "look": F.lit(1.0)}), None, [], 1.0
    for left in range(max_steps - 1, -1, -1):
        mass = lambda at, d: F.sum(F.col("tokens") * F.col(at) * F.get("p", F.lit(d)))
        got = stepped(base, steps).agg(*[mass(at, d).alias(f"{at}{d}") for at in ("rate", "look") for d in range(k)]).first()
        worst = max(abs((got[f"rate{d}"] or 0.0) - target[d]) / max(target[d], 0.001 * sum(n)) for d in usable)
        if worst < tolerance:
            break
        if not left:
            logging.getLogger(__name__).warning("the mix is off its targets by %.2g after %d steps", worst, max_steps)
        after = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        steps.append(([((got[f"look{d}"] or 0.0) - target[d]) / n[d] if d in usable else 0.0 for d in range(k)], (pace - 1) / after))
        pace = after
        if len(steps) == REPLAY:
            base, old = materialize(stepped(base, steps), "rates"), written
            written, steps = base, []
            if old is not None:
                discard(old)
    return stepped(base, steps).drop("look")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", upsample: bool = False, seed: int = 17) -> DataFrame:
    """(doc_id, tokens, domain, p_<domain>..., rate, copies, text_hash) for every row of ``docs``; ``labels`` (doc_id, domain).

    ``copies`` realises the rate: its whole part, and one more with the chance of the rest, drawn from the id.
    """
    weights = weights or WEIGHTS
    domains = list(weights)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit_classifier(rows, labels, domains)
    placed = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("tokens"), "text")
    members = materialize(model.posteriors(placed, F.col("text")).select("doc_id", "text_hash", "tokens", "p"), "members")
    rated = fit_rates(members, list(weights.values()), upsample)
    chance = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    best = F.get(F.array(*[F.lit(d) for d in domains]), F.array_position("p", F.array_max("p")).cast("int") - 1)
    return rated.select(
        "doc_id", "tokens", best.alias("domain"), *[F.round(F.get("p", F.lit(i)), 6).alias(f"p_{d}") for i, d in enumerate(domains)],
        F.round("rate", 6).alias("rate"), F.floor(F.col("rate") + chance).cast("int").alias("copies"),
        "text_hash",
    )
