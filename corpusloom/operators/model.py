"""Linear-softmax text classifier: training, scoring, explanations.

Training is full-batch gradient descent over all labelled rows. Equal texts are one row with the count of
each label, which gives the same sums. Rows lie in blocks by a hash of the text, in text order; every epoch
each block sums its gradient, chunk by chunk, and the blocks' sums are added in their order. The blocks depend
on the corpus and the candidates alone, so the number of cores or of the rows' partitions doesn't change a model;
parameters are rounded to 1e-12 every epoch. Few rows are trained in one task per candidate, more by one job per epoch.

Scoring is map-only: terms are made in the JVM, looked up and weighted in Arrow batches against the
broadcast model (at most 100,000 features by 256 labels), and never exploded or shuffled.

Defined results: a null text counts as an empty one; a text without features has the scores of the biases
and is never accepted; in the v3 profile a text of more than 512 characters counts as empty.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_CHARS, extract_terms, tokens
from . import features as V
from .checkpoints import cut

TOP = 8
CHUNK_ROWS = 512  # rows multiplied at once
BLOCK_WORK, MOST_BLOCKS = 2048 * 512, 48  # texts by features of a block, and blocks before these grow
LOCAL_WORK = 40_000 * 512  # up to so many texts by features a task trains a candidate sooner than a job per epoch would
DENSE_FEATURES = 4096  # up to so many a chunk is multiplied as a full matrix
SENT_MB = 300  # of all blocks' gradients in an epoch


@dataclass(frozen=True)
class Training:
    """``max_rows``: about the most distinct texts of a block; more texts are more blocks, none is left out."""

    epochs: int = 600
    learning_rate: float = 0.8
    l2: float = 0.0005
    max_rows: int = 100_000

    def __post_init__(self) -> None:
        if not 1 <= self.epochs <= 10_000 or not 1e-6 <= self.learning_rate <= 10 or not 0 <= self.l2 <= 1:
            raise ValueError("epochs must be 1..10000, learning_rate 1e-6..10, l2 0..1")


@dataclass(frozen=True)
class Model:
    """``weights`` is labels by features; thresholds and temperature belong to the decision."""

    labels: tuple[str, ...]
    vocabulary: tuple[str, ...]
    idf: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    biases: tuple[float, ...]
    profile: str = "v1"
    vectorizer: V.Vectorizer = field(default_factory=V.Vectorizer)
    temperature: float = 1.0
    min_confidence: float = 0.0
    min_margin: float = 0.0
    dataset: str = ""
    split_plan: str = ""

    def __post_init__(self) -> None:
        """Rejects models that aren't rectangular, finite, bounded and uniquely labelled."""
        n = len(self.vocabulary)
        if len(set(self.labels)) != len(self.labels) or not 2 <= len(self.labels) <= 256 or "" in self.labels:
            raise ValueError("labels must be 2..256, unique and not empty")
        if len(self.idf) != n or len(self.weights) != len(self.labels) or len(self.biases) != len(self.labels) or any(len(w) != n for w in self.weights):
            raise ValueError("the parameters' shapes don't match")
        if len(set(self.vocabulary)) != n or any(not 1 <= x <= 64 for x in self.idf):
            raise ValueError("the vocabulary must be unique with idf in 1..64")
        if not all(math.isfinite(x) and abs(x) <= 1e6 for w in (*self.weights, self.biases) for x in w):
            raise ValueError("parameters must be finite and at most 1e6")
        if not 0.05 <= self.temperature <= 20 or not 0 <= self.min_confidence <= 1 or not 0 <= self.min_margin <= 1:
            raise ValueError("temperature must be 0.05..20, thresholds 0..1")
        shape = r"[0-9a-f]{64}|fnv1a64:[0-9a-f]{16}"
        if any(x and not re.fullmatch(shape, x) for x in (self.dataset, self.split_plan)):
            raise ValueError("a model names its corpus and its split plan by their digests")

    def with_policy(self, **policy: float) -> Model:
        return replace(self, **policy)


def round_half_away(x: np.ndarray, scale: float = 1e12) -> np.ndarray:
    y = x * scale
    return np.sign(y) * np.floor(np.abs(y) + 0.5) / scale


def softmax_rows(logits: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    """Max-shifted softmax of each row; sums run over the labels in order."""
    z = logits / temperature if temperature != 1.0 else logits
    z = z - z.max(axis=1, keepdims=True)
    e = np.array([math.exp(v) for v in z.ravel().tolist()]).reshape(z.shape)
    total = np.zeros(len(e))
    for k in range(e.shape[1]):
        total = total + e[:, k]
    return e / total[:, None]


def sparse_logits(row: np.ndarray, position: np.ndarray, value: np.ndarray, n_rows: int, weights: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """Rows' features come sorted by position; each sum runs in that order, the bias is added last."""
    out = np.empty((n_rows, len(biases)))
    for k in range(len(biases)):
        out[:, k] = biases[k] + np.bincount(row, weights=weights[k][position] * value, minlength=n_rows)
    return out


Chunk = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # features per row, position, value, rows per row and label
Group = tuple[np.ndarray, np.ndarray]  # candidates of one number of features: weights (candidate, label, feature), biases (candidate, label)


def chunk_gradient(chunk: Chunk, groups: Sequence[Group], dense: np.ndarray | None = None) -> list[Group]:
    """Sums over a chunk's rows of the error times the features, and of the error. ``dense``: zeros to work in, and zeros afterwards."""
    size, position, value, hits = chunk
    n, widest = len(size), max(w.shape[2] for w, _ in groups)
    row = np.repeat(np.arange(n), size)
    if dense is not None:
        cells = row * dense.shape[1] + position
        dense.ravel()[cells] = value
    times = hits.sum(axis=1)[:, None, None]
    out = []
    for w, b in groups:
        g, k, f = w.shape
        flat, scale, r, p, v = w.reshape(g * k, f), None, row, position, value
        if f < widest:  # Euclidean length one within fewer features
            at = position < f
            r, p, v = row[at], position[at], value[at]
            length = np.sqrt(np.bincount(r, weights=v * v, minlength=n))
            scale = (1.0 / np.where(length > 0, length, 1.0))[:, None]
        z = dense[:n, :f] @ flat.T if dense is not None else np.stack([np.bincount(r, weights=x[p] * v, minlength=n) for x in flat], axis=1)
        z = (z if scale is None else z * scale).reshape(n, g, k) + b
        error = np.exp(z - z.max(axis=2, keepdims=True))
        error *= times / error.sum(axis=2, keepdims=True)
        error -= hits[:, None, :]
        e = error.reshape(n, g * k) if scale is None else error.reshape(n, g * k) * scale
        gradient = e.T @ dense[:n, :f] if dense is not None else np.stack([np.bincount(p, weights=x[r] * v, minlength=f) for x in e.T])
        out.append((gradient.reshape(g, k, f), error.sum(axis=0)))
    if dense is not None:
        dense.ravel()[cells] = 0.0
    return out


def block_gradients(chunks: Iterator[tuple[int, Chunk]], groups: Sequence[Group]) -> list[tuple[int, list[Group]]]:
    """Each block's sums, chunk after chunk."""
    widest = max(w.shape[2] for w, _ in groups)
    dense = np.zeros((CHUNK_ROWS, widest)) if widest <= DENSE_FEATURES else None
    totals: dict[int, list[Group]] = {}
    for block, chunk in chunks:
        one = chunk_gradient(chunk, groups, dense)
        totals[block] = [(w + x, b + y) for (w, b), (x, y) in zip(totals[block], one)] if block in totals else one
    return list(totals.items())


def descend_groups(gradients: Callable[[Sequence[Group]], list[tuple[int, list[Group]]]], n: float, n_labels: int, sizes: Sequence[int], configs: Sequence[Sequence[Training]]) -> list[Group]:
    """The parameters after all epochs. ``gradients``: the blocks' sums for given parameters; ``configs``: by size."""
    groups = [(np.zeros((len(c), n_labels, f)), np.zeros((len(c), n_labels))) for f, c in zip(sizes, configs)]
    for epoch in range(max(c.epochs for cs in configs for c in cs)):
        total: list[Group] = [(np.zeros_like(w), np.zeros_like(b)) for w, b in groups]
        for _, block in sorted(gradients(groups), key=lambda x: x[0]):
            total = [(w + x, b + y) for (w, b), (x, y) in zip(total, block)]
        for i, ((w, b), (x, y), cs) in enumerate(zip(groups, total, configs)):
            rate = np.array([c.learning_rate / math.sqrt(1.0 + epoch * 0.025) if epoch < c.epochs else 0.0 for c in cs])[:, None]
            l2 = np.array([c.l2 for c in cs])[:, None, None]
            groups[i] = round_half_away(w - rate[:, :, None] * (x / n + l2 * w)), round_half_away(b - rate * (y / n))
    return groups


def descend(row: np.ndarray, position: np.ndarray, value: np.ndarray, target: np.ndarray, n_labels: int, n_features: int, config: Training) -> tuple[np.ndarray, np.ndarray]:
    n = len(target)
    at = range(0, n, CHUNK_ROWS)
    size, start = np.bincount(row, minlength=n), np.searchsorted(row, [*at, n])
    chunks = [(size[i : i + CHUNK_ROWS], position[lo:hi], value[lo:hi], np.eye(n_labels)[target[i : i + CHUNK_ROWS]]) for i, lo, hi in zip(at, start, start[1:])]
    w, b = descend_groups(lambda groups: block_gradients(((0, c) for c in chunks), groups), max(n, 1), n_labels, [n_features], [[config]])[0]
    return w[0], b[0]


def train(rows: DataFrame, config: Training = Training(), vectorizer: V.Vectorizer = V.Vectorizer(), profile: str = "v1", row: str = "id", label: str = "label", text: str = "text") -> Model:
    """A model of the labelled rows with text, all of them. Rows count each, whatever their ids."""
    return train_candidates(rows, [(vectorizer, config)], profile, row, label, text)[0]


def chunked(texts: DataFrame, vocabulary: Sequence[str], idf: Sequence[float], n_labels: int, n_blocks: int, profile: str, vectorizer: V.Vectorizer) -> RDD:
    """Block and chunk, pickled; a block's chunks lie in order in one partition. ``texts``: text ``t``, its labels' places ``k`` and their rows ``n``."""
    held = texts.sparkSession.sparkContext.broadcast((list(vocabulary), list(idf)))
    placed = texts.repartition(n_blocks, "t").sortWithinPartitions("t").select(extract_terms(tokens("t", profile), vectorizer.word, vectorizer.char).alias("terms"), "k", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = held.value
        names, weights = pa.array(names, pa.string()), np.array(weights, float)
        rest: Chunk = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros((0, n_labels)))
        pickled = lambda c: pa.RecordBatch.from_arrays([pa.array([pickle.dumps(c, 5)], pa.binary())], ["chunk"])
        for batch in batches:
            rec, position, value = V.sparse_batch(batch.column("terms"), names, weights)
            k = batch.column("k")
            hits = np.zeros((batch.num_rows, n_labels))
            hits[np.repeat(np.arange(batch.num_rows), np.diff(k.offsets.to_numpy())), k.flatten().to_numpy()] = batch.column("n").flatten().to_numpy()
            size, position, value, hits = (np.concatenate(x) for x in zip(rest, (np.bincount(rec, minlength=batch.num_rows), position.astype(np.int32), value, hits)))
            # Chunks have a fixed number of rows, however the batches came.
            whole = len(size) // CHUNK_ROWS * CHUNK_ROWS
            start = np.concatenate([[0], np.cumsum(size)])
            for i in range(0, whole, CHUNK_ROWS):
                of = slice(start[i], start[i + CHUNK_ROWS])
                yield pickled((size[i : i + CHUNK_ROWS], position[of], value[of], hits[i : i + CHUNK_ROWS]))
            rest = size[whole:], position[start[whole] :], value[start[whole] :], hits[whole:]
        if len(rest[0]):
            yield pickled(rest)

    made = placed.mapInArrow(run, "chunk binary").rdd
    return made.mapPartitionsWithIndex(lambda i, rows: ((i, bytes(r[0])) for r in rows))


def train_candidates(rows: DataFrame, candidates: Sequence[tuple[V.Vectorizer, Training]], profile: str, row: str, label: str, text: str) -> list[Model]:
    """A model per candidate, trained side by side on all labelled rows with text."""
    known = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("y"), F.col(text).alias("t"))
    each = cut(known.groupBy("t", "y").agg(F.count(F.lit(1)).alias("n")))
    labels = sorted(x["y"] for x in each.select("y").distinct().limit(257).collect())
    if not 2 <= len(labels) <= 256:
        raise ValueError("training needs 2..256 labels")
    largest = max((v for v, _ in candidates), key=lambda v: v.max_features)
    place = F.create_map(*[F.lit(x) for i, y in enumerate(labels) for x in (y, i)])
    # In at least as many partitions as cores, however small: every text makes hundreds of terms.
    context = rows.sparkSession.sparkContext
    n_parts = max(context.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = each.repartition(n_parts, "t").groupBy("t").agg(F.sum("n").alias("m"), F.collect_list(F.struct(place[F.col("y")].alias("k"), "n")).alias("e"))
    texts = cut(pairs.select("t", "m", F.col("e.k").alias("k"), F.col("e.n").alias("n")))
    count = texts.agg(F.count(F.lit(1)).alias("texts"), F.sum("m").alias("rows")).first()
    frequency = V.term_counts(texts, "m", "t", profile, largest).groupBy("term").agg(F.sum("m").alias("df"))
    terms = V.vocabulary(frequency, texts.agg(F.sum("m").alias("n_docs")), largest).orderBy("position").collect()  # at most max_features rows
    features = [min(v.max_features, len(terms)) for v, _ in candidates]
    sizes = sorted(set(features))
    of_size = [[i for i, f in enumerate(features) if f == size] for size in sizes]
    configs = [[candidates[i][1] for i in of] for of in of_size]
    # Blocks bound what a task holds and what all of them send.
    most_rows = min(c.max_rows for _, c in candidates)
    sent = max(1, SENT_MB * 10**6 // (8 * len(labels) * max(1, sum(features))))
    block_rows = max(CHUNK_ROWS, BLOCK_WORK // max(1, sum(features)))
    n_blocks = max(1, min(sent, max(min(MOST_BLOCKS, -(-count["texts"] // block_rows)), -(-count["texts"] // most_rows))))
    n_rows, n_labels = count["rows"], len(labels)
    blocks = chunked(texts, [t["term"] for t in terms], [t["idf"] for t in terms], n_labels, n_blocks, profile, largest)
    if count["texts"] <= most_rows and count["texts"] * max(features) <= LOCAL_WORK:
        held = context.broadcast(blocks.collect())  # bounded by LOCAL_WORK

        def one(i: int) -> Group:
            chunks = [(block, _narrow(pickle.loads(c), sizes[i])) for block, c in held.value]
            return descend_groups(lambda groups: block_gradients(iter(chunks), groups), n_rows, n_labels, sizes[i : i + 1], configs[i : i + 1])[0]

        fitted = context.parallelize(range(len(sizes)), len(sizes)).map(one).collect()
        held.unpersist()
    else:
        # A task costs more than a block, so each takes as many blocks as there are for a core.
        blocks = blocks.coalesce(context.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sums = lambda groups: blocks.mapPartitions(lambda chunks: block_gradients(((i, pickle.loads(c)) for i, c in chunks), groups)).collect()
            fitted = descend_groups(sums, n_rows, n_labels, sizes, configs)
        finally:
            blocks.unpersist()
    fitted = {i: (w[j], b[j]) for of, (w, b) in zip(of_size, fitted) for j, i in enumerate(of)}
    out = []
    for i, (v, _) in enumerate(candidates):
        w, b = fitted[i]
        n = features[i]
        out.append(Model(tuple(labels), tuple(t["term"] for t in terms[:n]), tuple(t["idf"] for t in terms[:n]), tuple(map(tuple, w.tolist())), tuple(b.tolist()), profile, v))
    return out


def _narrow(chunk: Chunk, n_features: int) -> Chunk:
    """A chunk with its first features only, each row of Euclidean length one in them."""
    size, position, value, hits = chunk
    n = len(size)
    kept = position < n_features
    if kept.all():
        return chunk
    row, value = np.repeat(np.arange(n), size)[kept], value[kept]
    return np.bincount(row, minlength=n), position[kept], value / np.sqrt(np.bincount(row, weights=value * value, minlength=n))[row], hits


CONTRIBUTION = "array<struct<feature:string,value:double,weight:double,contribution:double>>"
PREDICTION = f"predicted string, accepted boolean, confidence double, margin double, has_features boolean, probabilities map<string,double>, logits array<double>, top_features {CONTRIBUTION}, runner_up string, logit_margin double, reconstructed_margin double, contrast array<struct<feature:string,value:double,top_weight:double,runner_up_weight:double,contribution:double>>"


def _top(rec: np.ndarray, order_value: np.ndarray, name_rank: np.ndarray, keep: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first TOP entries per row by value descending, then name; and how many each row has."""
    at = np.flatnonzero(keep)
    at = at[np.lexsort((name_rank[at], -order_value[at], rec[at]))]
    count = np.bincount(rec[at], minlength=n)
    start = np.cumsum(count) - count
    at = at[np.arange(len(at)) - start[rec[at]] < TOP]
    return at, np.bincount(rec[at], minlength=n)


def rejected(rows: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """Predictions of a model that isn't valid: its first label, never accepted, with probability 0."""
    label = labels[0] if labels and labels[0] else "invalid-model"
    kept = [c for c in rows.columns if c not in ("predicted", "accepted", "confidence", "margin", "has_features", "probabilities", "top_features")]
    return rows.select(
        *kept, F.lit(label).alias("predicted"), F.lit(False).alias("accepted"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("margin"), F.lit(False).alias("has_features"),
        F.create_map(F.lit(label), F.lit(0.0)).alias("probabilities"), F.array().cast(CONTRIBUTION).alias("top_features"),
    )


def score_or_reject(rows: DataFrame, parameters: dict, text: str = "text") -> DataFrame:
    """Scores with the model of these parameters, or rejects every row if they make none."""
    try:
        return score(rows, Model(**parameters), text)
    except (ValueError, TypeError):
        labels = parameters.get("labels") or ()
        return rejected(rows, [x if isinstance(x, str) else "" for x in labels])


def score(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` with the columns of PREDICTION, which replace any of the same names. No row moves to another task."""
    whole = F.when(F.length(text) > MAX_CHARS, F.lit("")).otherwise(F.coalesce(text, F.lit(""))) if model.profile == "v3" else F.coalesce(text, F.lit(""))
    v = model.vectorizer
    prepared = rows.withColumn("__terms", extract_terms(tokens(whole, model.profile), v.word, v.char))
    # Plain values only: a broadcast object's class would have to be installed on the executors.
    held = rows.sparkSession.sparkContext.broadcast(SimpleNamespace(**{k: getattr(model, k) for k in ("labels", "vocabulary", "idf", "weights", "biases", "temperature", "min_confidence", "min_margin")}))
    made = {*("predicted", "accepted", "confidence", "margin", "has_features", "probabilities", "logits", "top_features", "runner_up", "logit_margin", "reconstructed_margin", "contrast")}
    kept = [c for c in rows.columns if c not in made]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        vocabulary = pa.array(m.vocabulary, pa.string())
        idf, w, b = np.array(m.idf), np.array(m.weights).reshape(len(m.labels), -1), np.array(m.biases)
        rank = np.empty(len(m.vocabulary), np.int64)
        rank[np.argsort(np.array(m.vocabulary, object), kind="stable")] = np.arange(len(rank))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rec, position, value = V.sparse_batch(batch.column("__terms"), vocabulary, idf)
            logits = sparse_logits(rec, position, value, n, w, b)
            p = softmax_rows(logits, m.temperature)
            order = np.argsort(-p, axis=1, kind="stable")
            top, second = order[:, 0], order[:, 1]
            confidence = p[np.arange(n), top]
            margin = confidence - p[np.arange(n), second]
            has = np.bincount(rec, minlength=n) > 0
            accepted = (confidence >= m.min_confidence) & (margin >= m.min_margin) & has
            labels = np.array(m.labels, object)
            k = len(m.labels)
            probabilities = pa.MapArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(np.tile(labels, n), pa.string()), pa.array(p.ravel()))
            weight_top, weight_second = w[top[rec], position], w[second[rec], position]
            names = vocabulary
            contribution = value * weight_top
            pick, size = _top(rec, contribution, rank[position], contribution > 0, n)
            tops = pa.StructArray.from_arrays([names.take(pa.array(position[pick])), pa.array(value[pick]), pa.array(weight_top[pick]), pa.array(contribution[pick])], ["feature", "value", "weight", "contribution"])
            difference = value * (weight_top - weight_second)
            pick2, size2 = _top(rec, np.abs(difference), rank[position], np.ones(len(rec), bool), n)
            contrast = pa.StructArray.from_arrays([names.take(pa.array(position[pick2])), pa.array(value[pick2]), pa.array(weight_top[pick2]), pa.array(weight_second[pick2]), pa.array(difference[pick2])], ["feature", "value", "top_weight", "runner_up_weight", "contribution"])
            offsets = lambda s: pa.array(np.concatenate([[0], np.cumsum(s)]), pa.int32())
            out = {
                "predicted": pa.array(labels[top], pa.string()), "accepted": pa.array(accepted), "confidence": pa.array(confidence), "margin": pa.array(margin), "has_features": pa.array(has), "probabilities": probabilities,
                "logits": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(logits.ravel())),
                "top_features": pa.ListArray.from_arrays(offsets(size), tops), "runner_up": pa.array(labels[second], pa.string()),
                "logit_margin": pa.array(logits[np.arange(n), top] - logits[np.arange(n), second]),
                "reconstructed_margin": pa.array(b[top] - b[second] + np.bincount(rec, weights=difference, minlength=n)),
                "contrast": pa.ListArray.from_arrays(offsets(size2), contrast),
            }
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *out.values()], [*kept, *out])

    return prepared.mapInArrow(run, f"{ddl}, {PREDICTION}" if ddl else PREDICTION)
