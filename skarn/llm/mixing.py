"""Mixing sources to target weights by soft membership.

A naive Bayes classifier over hashed words, trained on labelled rows, gives every
document posteriors over the domains; its logits are scaled by one temperature fitted
on labelled rows that the counts did not use.  Document rates then minimise

    sum over domains of (sum_i rate_i * tokens_i * posterior_i[d] - target_d)**2

subject to ``low <= rate_i <= high`` by projected gradient descent.  A gradient is one
number per domain, a document's rate the fold of all gradients so far over its posterior,
clipped after each, so a step is one distributed sum over a small table of (tokens,
posteriors) and nothing else is kept between steps.  The gradient is scaled by the inverse
of the domains' joint moments over the documents whose rates are not at a bound, which
soft memberships need; where that does not lower the sum, it is shortened, and in the end
replaced by the division by the domains' token shares, whose steps always lower it.  The
descent stops when every domain is within ``TOLERANCE`` of its target, or when the sum
falls no more; the report says which.

A rate is carried out by repeating a row ``floor(rate)`` times and once more with the
probability of the rest, decided by a hash of the id.

Defined results: a null or wordless text gets the domains' shares as its posterior and
no tokens; null ids are kept; repeated rows share a rate; domains without a labelled row
don't exist; with no labelled rows, or an empty table, all rates are 1; other columns
are kept by ``mix`` and ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, free_names, labelled_sample, written
from .textops import row_sums, text_blocks, tokens

BUCKETS = 1 << 16
PER_DOMAIN = 3000
PRIOR_WORDS = 100.0
#: Rates are nonnegative; an upper bound is a choice of the caller, as it can keep a rare domain from its target.
LOW, HIGH = 0.0, float("inf")
STEPS, TOLERANCE = 100, 1e-4
#: Production weights of the domains (languages); those that a table lacks leave their share to the others.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


@dataclass
class Mixture:
    """The classifier, the gradients so far and the bounds: all that rates depend on."""

    domains: list[str]
    weights: np.ndarray  # bucket by domain: log-likelihoods
    prior: np.ndarray
    scale: float = 1.0
    low: float = LOW
    high: float = HIGH
    gradients: list[np.ndarray] = field(default_factory=list)

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posteriors) of the rows of a block."""
        hashes, _, at = tokens(data, offsets)
        n = np.diff(at)
        sums = row_sums(self.weights[_bucket(hashes)], at)
        return n, self.soften(sums, n)

    def soften(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        logits = np.log(np.maximum(self.prior, 1e-12)) + self.scale * sums / np.sqrt(np.maximum(n, 1))[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        rate = np.full(len(posterior), float(np.clip(1.0, self.low, self.high)))
        for g in self.gradients:
            rate = np.clip(rate - posterior @ g, self.low, self.high)
        return rate


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(24)).astype(np.int64) & (BUCKETS - 1)


def classifier(docs: DataFrame, labelled: DataFrame, per_domain: int = PER_DOMAIN, domain_col: str = "domain") -> Mixture | None:
    """The domain classifier from a bounded sample of the labelled table (doc_id, domain)."""
    sample = labelled_sample(docs, labelled, domain_col, F.lit(True), per_domain, "mixing-sample")
    domains = sorted(r[0] for r in sample.select("label").distinct().collect())
    if not domains:
        return None
    place = {d: i for i, d in enumerate(domains)}

    def count(batches):
        total, rows = np.zeros((len(domains), BUCKETS), np.int64), np.zeros(len(domains), np.int64)
        for part, data, offsets in text_blocks(batches):
            label = np.array([place[x] for x in part.column("label").to_pylist()], np.int64)
            hashes, _, at = tokens(data, offsets)
            key = np.repeat(label, np.diff(at)) * BUCKETS + _bucket(hashes)
            total += np.bincount(key, minlength=total.size).reshape(total.shape)
            rows += np.bincount(label, minlength=len(domains))
        some = np.flatnonzero(total.ravel())
        keys, n = np.append(some, -1 - np.arange(len(domains))), np.append(total.ravel()[some], rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    curve = F.crc32(F.concat_ws(":", F.lit("scale"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0
    found = sample.where(~curve).select("text", "label").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    key, n = found["key"].to_numpy(), found["n"].to_numpy(np.float64)
    counts = np.zeros(len(domains) * BUCKETS)
    counts[key[key >= 0]] = n[key >= 0]
    counts = counts.reshape(len(domains), BUCKETS)
    # Every domain's counts are filled up with so many words of all domains together: a small domain stays itself.
    pooled = counts.sum(axis=0) + 0.01
    counts = counts + PRIOR_WORDS * pooled / pooled.sum()
    shares = {r[0]: r[1] for r in columns_of(labelled, {"doc_id": "bigint", domain_col: "string"}).groupBy(domain_col).count().collect()}
    prior = np.array([shares[d] for d in domains], np.float64)
    model = Mixture(domains, np.log(counts / counts.sum(axis=1, keepdims=True)).T.copy(), prior / prior.sum())

    def logits(batches):
        for part, data, offsets in text_blocks(batches):
            hashes, _, at = tokens(data, offsets)
            sums = row_sums(model.weights[_bucket(hashes)], at)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(np.diff(at)), pa.array(list(sums), pa.list_(pa.float64()))], names=["label", "n", "sums"])

    seen = sample.where(curve).select("text", "label").mapInArrow(logits, "label string, n bigint, sums array<double>").toPandas()
    if len(seen):
        sums, size = np.stack(seen["sums"].to_list()), seen["n"].to_numpy()
        truth = np.array([place[x] for x in seen["label"]])

        def loss(scale: float) -> float:
            model.scale = scale
            return -float(np.log(np.maximum(model.soften(sums, size)[np.arange(len(truth)), truth], 1e-12)).mean())

        model.scale = min((2.0**k for k in range(-6, 7)), key=loss)
    return model


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, low: float = LOW, high: float = HIGH, domain_col: str = "domain", per_domain: int = PER_DOMAIN) -> tuple[Mixture | None, dict]:
    """The mixture and a report: per domain the target share, the expected share before and after, the steps taken and whether all targets are met.

    The expected total stays the table's own, unless ``low`` forbids that: then it is the
    least total at which every domain can keep ``low`` of its tokens.
    """
    model = classifier(docs, labelled, per_domain, domain_col)
    if model is None:
        return None, {}
    model.low, model.high = low, high
    names = [f"p{i}" for i in range(len(model.domains))]

    def memberships(batches):
        for _, data, offsets in text_blocks(batches):
            n, p = model.posteriors(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.float64)), *[pa.array(c.copy()) for c in p.T]], names=["tokens", *names])

    state = columns_of(docs, {"text": "string"}).mapInArrow(memberships, "tokens double, " + ", ".join(f"{c} double" for c in names)).where("tokens > 0")
    state = written(state, "mixing-state")

    size = len(names)
    moments = [f"m{i}" for i in range(size * size)]

    def expected(more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens by domain after the gradients so far and some more, and the joint moments of the free documents."""
        trial = replace(model, gradients=model.gradients + more)

        def run(batches):
            total, joint = np.zeros(size), np.zeros((size, size))
            for batch in batches:
                p, n = np.stack([batch.column(c).to_numpy() for c in names], axis=1), batch.column("tokens").to_numpy()
                rate = trial.rates(p)
                total += (rate * n) @ p
                free = (rate > low) & (rate < high)
                joint += (p[free] * n[free, None]).T @ p[free]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*total, *joint.ravel())], names=names + moments)

        row = state.mapInArrow(run, ", ".join(f"{c} double" for c in names + moments)).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names + moments]).first()
        return np.array(row[:size]), np.array(row[size:]).reshape(size, size)

    now, joint = expected([])
    total = now.sum()
    if not total:
        return model, {}
    wanted = np.array([(targets or TARGETS).get(d, 0.0) for d in model.domains])
    wanted = wanted / wanted.sum() if wanted.sum() else now / total
    if low:
        total = max(total, max((low * a / w for a, w in zip(now, wanted, strict=True) if w), default=total))
    before = now / now.sum()
    share = np.maximum(now / total, 1e-6)
    loss = lambda x: float((((x / total) - wanted) ** 2 / share).sum())
    for _ in range(STEPS):
        residual = now / total - wanted
        if np.abs(residual).max() < TOLERANCE:
            break
        scaled = np.linalg.solve(joint / total + 1e-4 * np.diag(share), residual)
        for gradient in (scaled, scaled / 4, scaled / 16, residual / share):
            after, others = expected([gradient])
            if loss(after) < loss(now) * (1 - 1e-3):
                break
        else:
            break
        model.gradients.append(gradient)
        now, joint = after, others
    report = {d: {"target": float(w), "before": float(b), "after": float(a)} for d, w, b, a in zip(model.domains, wanted, before, now / total, strict=True)}
    return model, {"domains": report, "steps": len(model.gradients), "total": float(total), "met": bool(np.abs(now / total - wanted).max() < TOLERANCE)}


def _copies(rate):
    """Whole repeats of a rate, and one more with the probability of the rest by a hash of the id."""
    luck = (F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return (F.floor(rate) + (luck < rate - F.floor(rate)).cast("bigint")).cast("int")


def rated(docs: DataFrame, model: Mixture | None) -> DataFrame:
    """doc_id, tokens, domain (the likeliest), posterior (of it), rate and copies of every row."""
    rows = columns_of(docs, {"doc_id": "bigint", "text": "string"})
    if model is None:
        return rows.select("doc_id", F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    found = rows.mapInArrow(_rater(model), "doc_id bigint, tokens bigint, domain string, posterior double, rate double")
    return found.withColumn("copies", _copies(F.col("rate")))


def _rater(model: Mixture):
    def run(batches):
        for part, data, offsets in text_blocks(batches):
            n, p = model.posteriors(data, offsets)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array([model.domains[i] for i in best], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(model.rates(p))], names=["doc_id", "tokens", "domain", "posterior", "rate"]
            )

    return run


def mix(docs: DataFrame, model: Mixture | None) -> DataFrame:
    """``docs`` itself with every row repeated as its rate says (all columns kept)."""
    if model is None:
        return docs
    rate, copies, copy = free_names(docs, "rate", "copies", "copy")

    def run(batches):
        for part, data, offsets in text_blocks(batches):
            _, p = model.posteriors(data, offsets)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.rates(p))], names=[*part.schema.names, rate])

    schema = docs.limit(0).withColumn(rate, F.lit(0.0)).schema
    rows = docs.mapInArrow(run, schema).withColumn(copies, _copies(F.col(rate)))
    return rows.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
