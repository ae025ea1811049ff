"""Operator 2: mixing sources to target weights by soft membership.

A classifier fitted on a bounded sample of a labelled table gives each document a posterior over domains.  The
rates r >= ``floor`` solve the least squares problem

    min 1/2 sum_k ((sum_i r_i n_i p_ik - T_k) / S)^2 + ridge/2 sum_i (n_i / S) (r_i - 1)^2

with n_i words, posteriors p_i, S = sum n_i, and targets T_k: expected domain totals match the weights, and rates
stay as near to 1 as that allows.  It is solved by distributed projected gradient steps with momentum.  A step needs
one vector of K totals from the data; a rate follows from the posteriors and the vectors so far, so no rate is stored.

With ``floor`` 0 (the default) the total stays and rates are nonnegative; with 1 no document is dropped, and the total
grows until the scarcest domain meets its weight.
Copies of a document are floor(rate + u), u uniform in the id's hash, so their expectation is the rate.

Defined results: null and empty texts have no words, weigh nothing and get the rate of their prior posterior;
repeated rows are separate rows; ids of any type, null included, are carried; of equally likely domains the first of the
targets is named; an empty table gives an empty result; domains of targets that no labelled row has get probability 0;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh, stored
from .quality import labelled_sample
from .subword import SubwordModel, fit, score_documents

#: Weights of the languages in the mixture, and labelled rows per domain that the fit reads.
TARGETS = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}
FIT_PER_DOMAIN = 400
STEPS, TOLERANCE, RIDGE = 100, 2e-4, 1e-3


def fit_domains(docs: DataFrame, labels: DataFrame, domain: str, names: list[str], per_domain: int = FIT_PER_DOMAIN) -> SubwordModel:
    """Posteriors over ``names``; labelled rows are the documents listed in ``labels``, their class is ``domain``."""
    index = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(domain))
    marked = docs.select("doc_id", domain).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    texts, y, prior = labelled_sample(docs, marked.select("doc_id", (index - 1).cast("int").alias("y")), "y", per_domain, len(names))
    if not texts:
        return SubwordModel(np.zeros((4, len(names)), np.float32), np.zeros(len(names)))
    return fit(texts, y, len(names), prior / prior.sum(), epochs=4, sizes=(3, 4))


class Rates:
    """Rates as a function of posteriors: the projected steps along the gradient vectors so far, with momentum."""

    def __init__(self, floor: float, ridge: float, eta: float = 1.0):
        self.floor, self.ridge, self.eta, self.slopes = floor, ridge, eta, []

    def __call__(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rate, point at which the next gradient is taken) of each row."""
        r, y, t = np.ones(len(p)), np.ones(len(p)), 1.0
        for g in self.slopes:
            new = np.maximum(self.floor, y - self.eta * (p @ g + self.ridge * (y - 1)))
            t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            r, y = new, new + (last - 1) / t * (new - r)
        return r, y


def _posteriors(b: pa.RecordBatch) -> np.ndarray:
    return b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _totals(members: DataFrame, of: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """Sums over all rows of ``n * of(p)`` (columns of numbers); each task sends one row."""

    def run(batches):
        got = np.zeros(k)
        for b in batches:
            got += b.column("n").to_numpy(zero_copy_only=False) @ of(_posteriors(b)) if b.num_rows else 0
        yield pa.record_batch([pa.array([x]) for x in got], [f"t{j}" for j in range(k)])

    parts = members.select("n", "p").mapInArrow(run, ", ".join(f"t{j} double" for j in range(k)))
    return np.array([x or 0.0 for x in parts.agg(*[F.sum(f"t{j}") for j in range(k)]).first()])


def solve_rates(members: DataFrame, weights: list[float], floor: float = 0.0, steps: int = STEPS, ridge: float = RIDGE) -> Rates:
    """Rates for ``members``, whose columns ``n`` and ``p`` are words and posteriors."""
    k = len(weights)
    want = np.array(weights, float) / sum(weights)
    first = _totals(members, lambda p: np.concatenate([p, (p[:, :, None] * p[:, None, :]).reshape(len(p), -1)], 1), k + k * k)
    now, total = first[:k], first[:k].sum()
    rates = Rates(floor, ridge)
    if total <= 0:
        return rates
    # the greatest curvature of the problem gives the step of the accelerated method
    rates.eta = 1 / (np.linalg.eigvalsh(first[k:].reshape(k, k) / total)[-1] + ridge)
    share = now / total
    target = want * (max([1.0, *(share[want > 0] / want[want > 0] * floor)]) if floor > 0 else 1.0)
    for _ in range(steps):
        off = _totals(members, lambda p: p * rates(p)[1][:, None], k) / total - target
        if rates.slopes and np.abs(off - rates.slopes[-1]).max() < TOLERANCE / 10:
            break
        rates.slopes.append(off)
    return rates


def with_rates(members: DataFrame, rates: Rates, name: str) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(rates(_posteriors(b))[0])], [*b.schema.names, name])

    return members.mapInArrow(run, T.StructType([*members.schema.fields, T.StructField(name, T.DoubleType())]))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "lang", floor: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, then likeliest domain, words, rate and copies (the last four columns), one row per document."""
    keep = keep or ["doc_id"]
    names = list(targets)
    model = fit_domains(docs, labels, domain, names)
    last = [fresh(x, keep) for x in ("domain", "n_words", "rate", "copies")]
    held = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col("doc_id").alias("id"), F.col("text").alias("whole"))
    kept = [f"c{i}" for i in range(len(keep))]
    members = stored(score_documents(held, model, [*kept, "id"], text="whole", out="p", words="n"), "members")
    best = F.array_position("p", F.array_max("p")).cast("int")
    u = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    likeliest = F.element_at(F.array(*[F.lit(x) for x in names]), best)
    rated = with_rates(members, solve_rates(members, [targets[x] for x in names], floor), "r")
    return rated.select(
        *[F.col(x).alias(c) for x, c in zip(kept, keep, strict=True)], likeliest.alias(last[0]), F.col("n").alias(last[1]), F.col("r").alias(last[2]), F.floor(F.col("r") + u).cast("int").alias(last[3])
    )


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mix(docs, labels, TARGETS)
