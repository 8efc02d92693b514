"""Toxicity by a classifier chain.

Categories are predicted one after another: ``insult`` (a toxic text with a word
of a public list of insults), ``coded`` (a toxic text without any, so the abuse
is in other words or languages) and ``toxic`` itself. Each category has a linear
model over word and word-prefix features; later models also see the
probabilities of the earlier ones. For training those are predicted out of
fold: a row's earlier probability comes from a model that has not seen it.

The fit uses a documented, bounded sample of labelled rows (``SAMPLE`` of each
class, by a hash of the id), weighted back to the classes' true sizes, which
are counted over all labels. The sample is found by a join with at most
2 * SAMPLE broadcast ids; feature counts of its texts are summed by Spark, the
most associated ``FEATURES`` of each category are kept, and the sparse rows
(bounded by the sample) train the models. Scoring is one pass over whole
texts, without a shuffle.

Defined cases: null and blank texts have no feature and are not toxic; labels
that are null or not 0 or 1 are passed over, of an id's several labels the
largest counts; without toxic or without clean labels nothing is toxic;
repeated rows are scored alike; extra columns are passed over; an empty table
gives no row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import reliable, table

#: Most labelled rows of each class that the fit uses.
SAMPLE = 3000
#: Features kept for each category, the fewest sampled toxic texts with one, and how much
#: more often than in clean texts it must be.
FEATURES, LEAST, ODDS = 160, 5, 8.0
FOLDS, ROUNDS, RIDGE = 3, 30, 0.01
THRESHOLD = 0.5
CATEGORIES = ["insult", "coded", "toxic"]
#: Insults of the first category: common English words.
INSULTS = frozenset(
    b"idiot moron stupid dumb fool loser clown scum trash garbage pathetic worthless disgusting ugly jerk imbecile creep filth vermin".split()
)
PREFIXES = (4, 5, 6)
#: ASCII letters in lower case, signs and digits as spaces.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 128 and not 97 <= c <= 122 else c for c in range(256)
)


def words(data: bytes) -> set[bytes]:
    """The distinct words of a whole text."""
    return set(data.translate(_PLAIN).split())


def features(found: set[bytes]) -> set[bytes]:
    """Words, and their longer prefixes with a star."""
    out = set(found)
    for w in found:
        for k in PREFIXES:
            if len(w) > k:
                out.add(w[:k] + b"*")
    return out


@dataclass
class Chain:
    """Feature indexes and, for each category, weights, weights of the earlier probabilities, and bias."""

    index: dict[bytes, int] = field(default_factory=dict)
    models: list[tuple[np.ndarray, np.ndarray, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.short = frozenset(f for f in self.index if len(f) < PREFIXES[0])
        self.roots = frozenset(f[: PREFIXES[0]] for f in self.index)

    def hits(self, data: bytes) -> list[int]:
        """Indexes of a text's features."""
        found = words(data)
        near = {w for w in found if w[: PREFIXES[0]] in self.roots}
        return sorted(self.index[f] for f in features(near) | (found & self.short) if f in self.index)

    def probabilities(self, hits: list[int]) -> list[float]:
        """One of each category, each after the ones before it."""
        if not self.models or not hits:
            return [0.0] * len(CATEGORIES)
        out: list[float] = []
        for weights, earlier, bias in self.models:
            z = weights[hits].sum() + float(np.dot(earlier, out)) + bias
            out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return out


def _logistic(hits: np.ndarray, extra: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression on 0/1 columns, further columns and a bias, by Newton steps that never lose ground."""
    size, k = hits.shape[1], extra.shape[1]
    used = weight > 0
    x = np.column_stack([hits[used], extra[used].astype(np.float32), np.ones(used.sum(), np.float32)])
    y, share = target[used], weight[used]
    ridge = np.full(size + k + 1, RIDGE)
    ridge[-1] = 1e-6
    w = np.zeros(size + k + 1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((share * (np.logaddexp(0, z) - y * z)).sum() + (ridge * w * w).sum() / 2)

    now = loss(w)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (share * (p - y)) + ridge * w
        curve = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None].astype(np.float32)).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        scale = 1.0
        while (then := loss(w - scale * step)) > now and scale > 1e-4:
            scale /= 2
        w, gain, now = w - scale * step, now - then, then
        if gain < 1e-4:
            break
    return w[:size], w[size : size + k], float(w[-1])


def train_chain(index: dict[bytes, int], hits: list[list[int]], targets: np.ndarray, folds: np.ndarray, weight: np.ndarray) -> Chain:
    """Models of all categories in order; ``targets`` has a column of each."""
    n = len(hits)
    x = np.zeros((n, len(index)), np.float32)
    for i, h in enumerate(hits):
        x[i, h] = 1
    earlier = np.zeros((n, 0))
    models = []
    for y in targets.T:
        models.append(_logistic(x, earlier, y, weight))
        unseen = np.zeros(n)
        for f in range(FOLDS):
            out = folds == f
            if (weight * ~out).sum():
                w, v, bias = _logistic(x, earlier, y, weight * ~out)
                z = x[out] @ w + earlier[out] @ v + bias
                unseen[out] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        earlier = np.column_stack([earlier, unseen])
    return Chain(index, models)


def _category_targets(toxic: np.ndarray, insult: np.ndarray) -> np.ndarray:
    """Columns of ``CATEGORIES``."""
    return np.column_stack([toxic & insult, toxic & ~insult, toxic]).astype(float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """Learn from a bounded sample of the labelled rows."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = reliable(known)
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Chain()
    chosen = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for t in (0, 1)]
    # at most 2 * SAMPLE ids
    sample = reliable(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen[0].unionAll(chosen[1])), "id").select(F.col("id").cast("string").alias("id"), "text", "toxic")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter(), Counter()]
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = words((text or "").encode())
                counts[0 if not toxic else 1 if found & INSULTS else 2].update(features(found))
        names = list(set().union(*counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), *[pa.array([c[f] for f in names], pa.int64()) for c in counts]], names=["feature", "clean", "insult", "coded"]
        )

    sums = sample.mapInArrow(count, "feature binary, clean long, insult long, coded long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("clean", "insult", "coded")])
    totals = sample.mapInArrow(_class_sizes, "clean long, insult long, coded long").agg(*[F.sum(c).alias(c) for c in ("clean", "insult", "coded")]).first()
    if not totals or not totals.clean or not (totals.insult or totals.coded):
        return Chain()
    sums = reliable(sums.filter(F.col("insult") + F.col("coded") >= LEAST))
    index: dict[bytes, int] = {}
    for kind in ("insult", "coded"):
        if totals[kind]:
            n = totals[kind] + totals.clean
            rate = (F.col(kind) + F.col("clean")) / n
            gap = F.col(kind) / totals[kind] - F.col("clean") / totals.clean
            score = gap / F.sqrt(rate * (1 - rate) * (1 / totals[kind] + 1 / totals.clean) + 1e-9)
            ratio = (F.col(kind) / totals[kind]) / ((F.col("clean") + 0.5) / totals.clean)
            for r in sums.filter((F.col(kind) >= LEAST) & (ratio >= ODDS)).orderBy(score.desc(), "feature").limit(FEATURES).collect():
                index.setdefault(bytes(r.feature), len(index))
    if not index:
        return Chain()
    chain = Chain(index)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("toxic"),
                    pa.array([bool(words(d) & INSULTS) for d in data], pa.bool_()),
                    pa.array([chain.hits(d) for d in data], pa.list_(pa.int32())),
                ],
                names=["id", "toxic", "insult", "hits"],
            )

    # bounded by the sample: at most 2 * SAMPLE rows of at most 2 * FEATURES numbers, unless ids repeat
    rows = sample.mapInArrow(sparse, "id string, toxic int, insult boolean, hits array<int>").dropDuplicates().orderBy("id", "hits").limit(2 * SAMPLE).collect()
    toxic = np.array([r.toxic == 1 for r in rows])
    insult = np.array([r.insult for r in rows])
    folds = np.array([zlib.crc32(r.id.encode()) % FOLDS for r in rows])
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    weight = np.where(toxic, sizes[1] / n_toxic, sizes[0] / n_clean)
    return train_chain(index, [r.hits for r in rows], _category_targets(toxic, insult), folds, weight / weight.mean())


def _class_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sizes = [0, 0, 0]
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            sizes[0 if not toxic else 1 if words((text or "").encode()) & INSULTS else 2] += 1
    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()) for s in sizes], names=["clean", "insult", "coded"])


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the categories' probabilities, ``n_features`` and ``toxic`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [shared.value.hits((t.as_py() or "").encode()) for t in batch.column("text")]
            found = [shared.value.probabilities(h) for h in hits]
            cols = list(zip(*found, strict=True)) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    *[pa.array(c, pa.float64()) for c in cols],
                    pa.array([len(h) for h in hits], pa.int64()),
                    pa.array([p[-1] >= THRESHOLD for p in found], pa.bool_()),
                ],
                names=[id_col, *names, "n_features", "toxic"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, {', '.join(f'{n} double' for n in names)}, n_features long, toxic boolean"
    )


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [shared.value.probabilities(shared.value.hits((t.as_py() or "").encode()))[-1] < THRESHOLD for t in batch.column(at)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``, learned from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
