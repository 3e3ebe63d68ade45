"""Toxicity score of whole texts by a convolutional network over hashed word embeddings.

Words (runs of letters and digits) are hashed into ``BUCKETS`` embeddings. Filters of widths 1, 2 and 3 slide over the
embedded words; the largest response of each filter over the whole text goes, through a rectifier, into a logistic
output. Embeddings and filters start at random, but for the first dimension, which starts at how much oftener the word
occurs in texts of label 1 than expected, in standard deviations (``word_start``; without it the network learns the
same words in more epochs, see README). Every labelled text teaches (of copies of one text one counts): five sixths,
by a hash of the id, the words and the network, the others the thresholds. Word counts are one aggregation over all
tasks. The network is trained in shards of about ``SHARD_ROWS`` texts, each by one task in plain numpy from the same
start, with gradients only through the place of the largest response; the result is the mean over the shards, of an
embedding over those shards that hold the word. Scoring runs over all texts in Arrow batches and reads every word.

Thresholds are calibrated by language. A language is never read from the table when scoring: the network has a
second output that guesses it from the mean embedding of the same words. For each guessed language the
threshold that best separates the calibration part is found, from counts of all its texts by guess, label and margin
(in steps of 1 / ``STEPS``), and the logistic output is shifted so that this threshold becomes the score 0.7.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lociary.llm.common import column_of, held_out, ship, slices, store, text_bytes
from lociary.llm.words import MARKS, word_hashes, word_spans
from lociary.operators.keyed import broadcast_bound

BUCKETS = 1 << 18
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 2
RATE = 0.05
BATCH = 32
KEPT_WORDS = 0.5
MIN_TEXTS = 2
SHARD_ROWS = 4000
SHARD_WORDS = 8_000_000
TUNING = 6  # one text in so many sets the thresholds
STEPS = 1000
MARGIN = 100.0
MAX_ROWS = 3000  # of a sample, where one is asked for
MAX_BYTES = 36_000_000
CUT = 0.7
LOGIT_CUT = float(np.log(CUT / (1 - CUT)))
PAD = BUCKETS  # an all-zero embedding between texts and for texts that are too short


@dataclass
class Network:
    embedding: np.ndarray  # BUCKETS + 1 rows, the last is zero
    filters: list[np.ndarray]  # per width: width x DIMENSIONS x FILTERS
    biases: list[np.ndarray]
    output: np.ndarray
    output_bias: float
    language: np.ndarray  # DIMENSIONS x languages
    language_bias: np.ndarray
    shifts: np.ndarray  # per language, added to the logistic output


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the words of all texts, and the number of words of each text."""
    buf, offsets = text_bytes(texts)
    starts, ends, counts = word_spans(buf, offsets, MARKS)
    return (word_hashes(buf, starts, ends) % np.uint64(BUCKETS)).astype(np.int32), counts


def _laid_out(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with padding after each text so that no filter reaches into the next; begins and lengths of the texts."""
    pad = max(WIDTHS)
    lengths = np.maximum(counts, 1)
    begins = np.cumsum(lengths + pad) - (lengths + pad)
    laid = np.full(int((lengths + pad).sum()), PAD, np.int32)
    if len(words):
        inside = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        laid[np.repeat(begins, counts) + inside] = words
    return laid, begins, lengths


def _responses(net: Network, laid: np.ndarray, k: int) -> np.ndarray:
    """Response of every filter of one width at every place."""
    width = WIDTHS[k]
    embedded = net.embedding[laid]
    out = np.zeros((len(laid), FILTERS), np.float32)
    for j in range(width):
        out[: len(laid) - j] += embedded[j:] @ net.filters[k][j]
    return out + net.biases[k]


def _largest(response: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Largest response over the places of each text."""
    bounds = np.empty(2 * len(begins), np.int64)
    bounds[0::2], bounds[1::2] = begins, begins + lengths
    return np.maximum.reduceat(np.vstack([response, response[-1:]]), bounds)[0::2]


def _forward(net: Network, laid: np.ndarray, begins: np.ndarray, lengths: np.ndarray):
    pooled = [_largest(_responses(net, laid, k), begins, lengths) for k in range(len(WIDTHS))]
    features = np.maximum(np.hstack(pooled), 0)
    return features, features @ net.output + net.output_bias


def guessed_language(net: Network, laid: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Number of the language that the mean embedding of each text fits best."""
    scores = (net.embedding[laid] @ net.language).astype(np.float64)
    bounds = np.empty(2 * len(begins), np.int64)
    bounds[0::2], bounds[1::2] = begins, begins + np.maximum(counts, 1)
    sums = np.add.reduceat(np.vstack([scores, scores[-1:]]), bounds)[0::2]
    return np.argmax(sums / np.maximum(counts, 1)[:, None] + net.language_bias, axis=1)


def _step(net: Network, state: dict, texts: list[np.ndarray], labels: np.ndarray, languages: np.ndarray, rate: float) -> None:
    """One Adagrad step on a mini-batch of the logistic loss and of the loss of the language guess."""
    counts = np.array([len(t) for t in texts])
    words = np.concatenate(texts) if counts.sum() else np.zeros(0, np.int32)
    laid, begins, lengths = _laid_out(words, counts)
    responses = [_responses(net, laid, k) for k in range(len(WIDTHS))]
    places = []
    for response in responses:
        places.append(np.array([b + np.argmax(response[b : b + n], axis=0) for b, n in zip(begins, lengths)]))
    pooled = np.hstack([r[p, np.arange(FILTERS)] for r, p in zip(responses, places)])
    features = np.maximum(pooled, 0)
    margin = features @ net.output + net.output_bias
    error = (1 / (1 + np.exp(-margin)) - labels) / len(labels)
    down = np.outer(error, net.output) * (pooled > 0)
    rows, grads = [], []
    for k, width in enumerate(WIDTHS):
        part = down[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
        for j in range(width):
            at = laid[places[k] + j]
            gradient = np.einsum("nf,nfd->df", part, net.embedding[at])
            rows.append(at.ravel())
            grads.append((part[:, :, None] * net.filters[k][j].T[None]).reshape(-1, DIMENSIONS))
            _adagrad(net.filters[k][j], gradient, state, (k, j), rate)
        _adagrad(net.biases[k], part.sum(0), state, (k, "b"), rate)
    _adagrad(net.output, features.T @ error, state, "o", rate)
    bias = np.array([net.output_bias])
    _adagrad(bias, np.array([error.sum()]), state, "ob", rate)
    net.output_bias = float(bias[0])
    mean = np.array([net.embedding[t].mean(0) if len(t) else np.zeros(DIMENSIONS) for t in texts])
    logits = mean @ net.language + net.language_bias
    shares = np.exp(logits - logits.max(1, keepdims=True))
    shares /= shares.sum(1, keepdims=True)
    wrong = (shares - np.eye(len(net.language_bias))[languages]) * (languages >= 0)[:, None] / len(labels)
    back = wrong @ net.language.T
    for text, b, n in zip(texts, back, counts):
        if n:
            rows.append(text)
            grads.append(np.repeat((b / n)[None], n, 0))
    _adagrad(net.language, mean.T @ wrong, state, "l", rate)
    _adagrad(net.language_bias, wrong.sum(0), state, "lb", rate)
    at, gradient = np.concatenate(rows), np.concatenate(grads)
    used, inverse = np.unique(at, return_inverse=True)
    total = np.stack([np.bincount(inverse, gradient[:, d], len(used)) for d in range(DIMENSIONS)], 1)
    past = state.setdefault("e", np.full((BUCKETS + 1, DIMENSIONS), 1e-4, np.float32))
    past[used] += total**2
    net.embedding[used] -= (rate * total / np.sqrt(past[used])).astype(np.float32)
    net.embedding[PAD] = 0


def _adagrad(value: np.ndarray, gradient: np.ndarray, state: dict, key, rate: float) -> None:
    past = state.setdefault(key, np.full(value.shape, 1e-4))
    past += gradient**2
    value -= (rate * gradient / np.sqrt(past)).astype(value.dtype)


def fit(
    texts: list[np.ndarray], labels: np.ndarray, languages: np.ndarray, n_languages: int, prior: float,
    *, seed: int = 5, word_start: bool = True, epochs: int = EPOCHS, rate: float = RATE,
) -> Network:
    """Train on five sixths of the rows, calibrate on the rest. ``prior``: share of label 1 among all labelled rows."""
    rng = np.random.default_rng(seed)
    net = _new(rng, n_languages)
    if not len(texts) or labels.min() == labels.max():
        return _of_one_class(net, prior)
    order = rng.permutation(len(texts))
    tuning, training = order[: len(order) // TUNING], order[len(order) // TUNING :]
    own, marks = [texts[i] for i in training], labels[training]
    counts = np.zeros((2, BUCKETS))
    for text, label in zip(own, marks):
        counts[label][np.unique(text)] += 1
    known = _start(net, counts, float(marks.mean()), word_start)
    _learn(net, known, own, marks, languages[training], rng, epochs, rate)
    judged = [_margins(net, texts[i], np.array([len(texts[i])])) for i in tuning]
    margins, guesses = [np.array([j[k][0] for j in judged]) for k in (0, 1)]
    _calibrate(net, margins, guesses.astype(np.int64), labels[tuning], np.ones(len(tuning)), prior)
    return net


def _new(rng: np.random.Generator, n_languages: int) -> Network:
    return Network(
        (rng.standard_normal((BUCKETS + 1, DIMENSIONS)) * 0.1).astype(np.float32),
        [(rng.standard_normal((w, DIMENSIONS, FILTERS)) * 0.3 / np.sqrt(w)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3, -1.0,
        np.zeros((DIMENSIONS, n_languages)), np.zeros(n_languages), np.zeros(n_languages),
    )


def _of_one_class(net: Network, prior: float) -> Network:
    """Nothing to tell apart: every text gets the smoothed share of label 1."""
    net.embedding[PAD] = 0
    net.output[:] = 0
    net.output_bias = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
    return net


def _learn(
    net: Network, known: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, languages: np.ndarray,
    rng: np.random.Generator, epochs: int = EPOCHS, rate: float = RATE,
) -> None:
    """An epoch takes every row of label 0 once and as many of label 1; of each text half of the words, drawn anew, so that
    no text is known by a few of its words. Words that are not ``known`` have no embedding."""
    state: dict = {}
    ones, zeros = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    for _ in range(epochs):
        rows = rng.permutation(len(texts))
        if len(ones) and len(zeros):
            again = np.concatenate([rng.permutation(ones) for _ in range(-(-len(zeros) // len(ones)))])[: len(zeros)]
            rows = np.stack([rng.permutation(zeros), again], 1).ravel()
        for at in range(0, len(rows), BATCH):
            chosen = rows[at : at + BATCH]
            _step(net, state, [texts[i][rng.random(len(texts[i])) < KEPT_WORDS] for i in chosen], labels[chosen], languages[chosen], rate)
            net.embedding[~known] = 0


def _start(net: Network, counts: np.ndarray, share: float, word_start: bool = True) -> np.ndarray:
    """Put the excess of each word in texts of label 1 into the first dimension, and let one filter of each width read it.

    ``counts``: texts of label 0 and 1 with the word. Returns which words are known; those in fewer than ``MIN_TEXTS``
    texts have no embedding.
    """
    known = np.append(counts.sum(0) >= MIN_TEXTS, False)
    if word_start:
        expected = counts.sum(0) * share
        excess = (counts[1] - expected) / np.sqrt(expected * (1 - share) + 4)
        net.embedding[:BUCKETS, 0] = np.clip(excess, -3, 6)
        for k, width in enumerate(WIDTHS):
            net.filters[k][:, 0, 0] += 1 / width
            net.output[k * FILTERS] += 1
        net.output_bias = -4.0
    net.embedding[~known] = 0
    return known


def _calibrate(net: Network, margins: np.ndarray, guesses: np.ndarray, labels: np.ndarray, counts: np.ndarray, prior: float) -> None:
    """Per guessed language the cut with the fewest weighted errors; few rows lean on the cut of all languages.

    ``counts`` texts each have that margin, guess and label.
    """
    ones = max((counts * labels).sum() / counts.sum(), 1e-6) if len(labels) else 0.5
    weights = counts * np.where(labels == 1, prior / ones, (1 - prior) / max(1 - ones, 1e-6))
    overall = _cut(margins, labels, weights)
    for language in range(len(net.shifts)):
        own = guesses == language
        positives, texts = (counts * labels)[own].sum(), counts[own].sum()
        trust = positives / (positives + 10)
        cut = _cut(margins[own], labels[own], weights[own]) if 0 < positives < texts else overall
        net.shifts[language] = LOGIT_CUT - (trust * cut + (1 - trust) * overall)


def _cut(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Middle of the widest best place to cut: rows at or above it count as label 1."""
    if not len(margins) or labels.min() == labels.max():
        return LOGIT_CUT
    order = np.argsort(margins)
    m, y, w = margins[order], labels[order], weights[order]
    wrong = np.concatenate([[0], np.cumsum(w * y)]) + np.concatenate([np.cumsum((w * (1 - y))[::-1])[::-1], [0]])
    edges = np.concatenate([[m[0] - 2], m, [m[-1] + 2]])
    gaps = np.diff(edges)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    k = best[np.argmax(gaps[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def _clear_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, label``: the labels 0 and 1 outside the held-out part; of repeated ones the larger counts."""
    clear = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    return clear.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))


def _texts(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "text", "lang" if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"))
    return own.filter(F.col("text").isNotNull())


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, float]:
    """A sample for quick trials: labelled rows outside the held-out part, at most ``max_rows`` of label 1 and twice as
    many of label 0; the share of label 1 among all.

    The ids are chosen first, from the labels alone; at most ``3 * max_rows`` of them are broadcast to find their texts.
    Of the found texts those stay that fit in their label's part of ``MAX_BYTES``; texts of more than an eighth of it come
    after all others, so that none ends the sample, and the first one of each label always stays.
    """
    clear = _clear_labels(labels).withColumn("order", F.xxhash64("doc_id"))
    share = clear.agg(F.avg("label")).first()[0]
    parts = [clear.filter(F.col("label") == label).orderBy("order", "doc_id").limit((2 - label) * max_rows) for label in (0, 1)]
    found = _texts(docs).join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("text", "label", "lang", "order")).alias("row"))
    rows = rows.select("row.*").withColumn("bytes", F.octet_length("text").cast("long")).withColumn("most", (2 - F.col("label")) * F.lit(MAX_BYTES // 3))
    order = Window.partitionBy("label").orderBy(F.col("bytes") > F.col("most") / 8, "order", "text")
    placed = rows.withColumn("number", F.row_number().over(order)).withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.filter("upto <= most OR number = 1").select("text", "label", "lang", "order"), float(share or 0.0)


def _hashed(rows: DataFrame) -> DataFrame:
    """The same rows with ``words``, the embedding rows of the words, in place of ``text``."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            words, counts = word_buckets(column_of(batch, "text"))
            parts = [p.tobytes() for p in np.split(words, np.cumsum(counts)[:-1])] if len(counts) else []
            yield pa.record_batch([*[column_of(batch, f.name) for f in kept], pa.array(parts, pa.binary())], names=[*[f.name for f in kept], "words"])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "words binary"]))


def _joined(texts: DataFrame, chosen: DataFrame, rows: int) -> DataFrame:
    """Texts of the chosen ids; the narrow table of ids is broadcast if it is small."""
    small = rows * 96 <= broadcast_bound(texts.sparkSession)
    return texts.join(F.broadcast(chosen) if small else chosen, "doc_id")


def labelled_texts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Every different labelled text outside the held-out part once, as its words; the share of label 1 among all labels.

    Returns the narrow stored table of the texts (``doc_id, digest, label, lang, order, n_words, copies``) and the rows with
    ``words``, read from the documents again wherever they are used. A text that repeats is known by the first id in the
    order of a hash, and takes that id's label; ``copies`` rows of that id hold it.
    """
    clear = _clear_labels(labels)
    total = clear.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    found = _hashed(_joined(_texts(docs), clear, total["n"]))
    # the text itself goes no further: what is grouped is its digest
    own = found.groupBy(F.md5("words").alias("digest"), "doc_id").agg(
        F.min(F.struct("label", "lang")).alias("x"), F.max(F.octet_length("words") / 4).cast("long").alias("n_words"), F.count("*").alias("copies")
    )
    first = F.min(F.struct(F.xxhash64("doc_id").alias("order"), "doc_id", "x.label", "x.lang", "n_words", "copies")).alias("first")
    chosen = store(own.groupBy("digest").agg(first).select("digest", "first.*"), "labelled")
    rows = _hashed(_joined(_texts(docs).drop("lang"), chosen, chosen.count()))
    return chosen, rows.filter(F.md5("words") == F.col("digest")), float(total["share"] or 0.0)


def train(docs: DataFrame, labels: DataFrame, max_rows: int | None = None) -> Network:
    """Fit on all of ``docs`` (doc_id, text, optional lang) that ``labels`` (doc_id, toxic) know, or on a sample."""
    ship(docs.sparkSession)
    if max_rows is not None:
        return _train_sample(*training_rows(docs, labels, max_rows))
    chosen, rows, prior = labelled_texts(docs, labels)
    teaching = F.pmod("order", F.lit(TUNING)) != 0
    sizes = chosen.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(teaching).alias("rows"), F.sum(F.when(teaching, F.col("label")).otherwise(0)).alias("ones"),
        F.sum(F.when(teaching, F.col("n_words")).otherwise(0)).alias("words"),
    ).toPandas()
    spoken = sizes.dropna(subset="lang").sort_values(["n", "lang"], ascending=[False, True])
    names = {x: k for k, x in enumerate(spoken["lang"])} or {"und": 0}
    n_rows, ones, words = (int(sizes[c].sum()) for c in ("rows", "ones", "words"))
    net = _new(np.random.default_rng(5), len(names))
    if not 0 < ones < n_rows:
        return _of_one_class(net, prior)
    shards = -(-max(n_rows * SHARD_WORDS, words * SHARD_ROWS) // (SHARD_ROWS * SHARD_WORDS))
    known = _start(net, _word_counts(rows.filter(teaching)), ones / n_rows)
    _average(net, _trained(rows.filter(teaching), net, known, names, shards).groupBy("row").agg(
        F.sum("weight").alias("weight"), *[F.sum(F.col("weight") * F.col(f"v{d}")).alias(f"v{d}") for d in range(DIMENSIONS)]
    ))
    cells = _tuned(rows.filter(~teaching), net).groupBy("guess", "step", "label").agg(F.sum("part").alias("n")).toPandas()
    cells = cells.sort_values(["guess", "step", "label"])
    _calibrate(net, cells["step"].to_numpy() / STEPS, cells["guess"].to_numpy(), cells["label"].to_numpy(np.int64), np.round(cells["n"].to_numpy(float)), prior)
    return net


def _train_sample(rows: DataFrame, prior: float) -> Network:
    sample = _hashed(rows).toPandas().sort_values(["order", "label"]).drop_duplicates("words")
    texts = [np.frombuffer(w, np.int32) for w in sample["words"]]
    names = {x: k for k, x in enumerate(sample["lang"].value_counts().index)} or {"und": 0}
    languages = np.array([names.get(x, -1) for x in sample["lang"]], np.int64)
    return fit(texts, sample["label"].to_numpy(np.int64), languages, len(names), prior)


def _word_counts(rows: DataFrame) -> np.ndarray:
    """Texts of label 0 and of label 1 with each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS))
        for batch in batches:
            for label, copies, words in zip(*(batch.column(c).to_pylist() for c in ("label", "copies", "words"))):
                counts[label][np.unique(np.frombuffer(words, np.int32))] += 1 / copies
        at = np.flatnonzero(counts.any(0)).astype(np.int32)
        yield pa.record_batch([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["word", "n0", "n1"])

    found = rows.mapInArrow(run, "word int, n0 double, n1 double").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[:, found["word"].to_numpy()] = np.round(found[["n0", "n1"]].to_numpy().T)
    return counts


def _dense(net: Network) -> list[np.ndarray]:
    return [*net.filters, *net.biases, net.output, net.language, net.language_bias]


def _trained(rows: DataFrame, net: Network, known: np.ndarray, names: dict[str, int], shards: int) -> DataFrame:
    """``row, weight, v0 .. v7``: every shard's embeddings of its words and, in rows from ``BUCKETS`` + 1 on, its other numbers."""
    start = rows.sparkSession.sparkContext.broadcast((net, known, names))
    values = [f"v{d}" for d in range(DIMENSIONS)]

    def one(shard: int, held: list[tuple]) -> pa.RecordBatch:
        net, known, names = copy.deepcopy(start.value)
        texts = [np.frombuffer(w, np.int32) for _, _, w in held]
        labels = np.array([x for x, _, _ in held], np.int64)
        _learn(net, known, texts, labels, np.array([names.get(x, -1) for _, x, _ in held], np.int64), np.random.default_rng([5, shard]))
        used = np.unique(np.concatenate(texts)).astype(np.int64)
        used = used[known[used]]
        flat = np.concatenate([*[x.ravel() for x in _dense(net)], [net.output_bias]])
        flat = np.append(flat, np.zeros(-len(flat) % DIMENSIONS)).reshape(-1, DIMENSIONS)
        at = np.concatenate([used, BUCKETS + 1 + np.arange(len(flat))])
        table = np.concatenate([net.embedding[used].astype(float), flat])
        # a shard that holds one class only says little
        weight = min(labels.sum(), (1 - labels).sum()) + 1e-3 * len(labels)
        return pa.record_batch([pa.array(at), pa.array(np.full(len(at), weight)), *[pa.array(x) for x in table.T.copy()]], names=["row", "weight", *values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, last = None, [], None
        for batch in batches:
            for s, digest, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "digest", "label", "lang", "words"))):
                if s != shard and held:
                    yield one(shard, held)
                    held = []
                if digest != last:  # rows of one id and text are neighbours
                    held.append(tuple(row))
                shard, last = s, digest
        if held:
            yield one(shard, held)

    # four places a shard, so that few share a task
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards))).repartition(4 * shards, "shard")
    return dealt.sortWithinPartitions("shard", "order", "digest").mapInArrow(run, ", ".join(["row long", "weight double", *[f"{v} double" for v in values]]))


def _average(net: Network, sums: DataFrame) -> None:
    """Put the weighted means over the shards into the network."""
    found = sums.toPandas().sort_values("row")
    at = found["row"].to_numpy()
    # in single precision the order in which shards were added does not show
    means = (found[[f"v{d}" for d in range(DIMENSIONS)]].to_numpy() / found[["weight"]].to_numpy()).astype(np.float32)
    net.embedding[at[at < BUCKETS]] = means[at < BUCKETS]
    flat, begin = means[at > BUCKETS].ravel().astype(float), 0
    for x in _dense(net):
        x[...] = flat[begin : begin + x.size].reshape(x.shape)
        begin += x.size
    net.output_bias = float(flat[begin])


def _tuned(rows: DataFrame, net: Network) -> DataFrame:
    """``guess, step, label, part`` of every text that sets the thresholds: guessed language and margin in whole steps."""
    model = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(w, np.int32) for w in batch.column("words").to_pylist()]
            judged = [_margins(model.value, t, np.array([len(t)])) for t in texts]
            margins = np.array([m[0] for m, _ in judged], float)
            steps = np.round(np.clip(margins, -MARGIN, MARGIN) * STEPS).astype(np.int64)
            parts = 1 / batch.column("copies").to_numpy(zero_copy_only=False).astype(float)
            yield pa.record_batch(
                [pa.array(np.array([int(g[0]) for _, g in judged], np.int64)), pa.array(steps), batch.column("label"), pa.array(parts)],
                names=["guess", "step", "label", "part"],
            )

    return rows.mapInArrow(run, "guess long, step long, label int, part double")


def score_texts(docs: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score`` and ``predicted``, by the text alone."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(net)
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in slices(batches, 256):
            words, counts = word_buckets(column_of(batch, "__text"))
            margin = np.empty(len(counts))
            ends = np.cumsum(counts)
            at = 0
            while at < len(counts):  # blocks of whole texts of about 200,000 words
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 200_000, side="right")))
                begin = ends[at - 1] if at else 0
                margin[at:to] = _block(net, words[begin : ends[to - 1]], counts[at:to])
                at = to
            score = np.round(1 / (1 + np.exp(-margin)), 9)
            columns = [column_of(batch, c) for c in keep]
            yield pa.record_batch([*columns, pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=[*keep, "score", "predicted"])

    own = docs.select(*keep, F.col("text").alias("__text"))
    return own.mapInArrow(run, ", ".join([*kept, "score double", "predicted int"]))


def _block(net: Network, words: np.ndarray, counts: np.ndarray, step: int = 200_000) -> np.ndarray:
    """Shifted outputs of some texts; one text of more words than ``step`` is read in overlapping parts."""
    margins, guesses = _margins(net, words, counts, step)
    return margins + net.shifts[guesses]


def _margins(net: Network, words: np.ndarray, counts: np.ndarray, step: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Outputs before the shift, and the guessed languages."""
    if len(counts) == 1 and counts[0] > step:
        overlap = max(WIDTHS) - 1
        tops, sums = [], np.zeros(len(net.language_bias))
        for at in range(0, len(words), step):
            laid, begins, lengths = _laid_out(words[at : at + step + overlap], np.array([len(words[at : at + step + overlap])]))
            tops.append(_forward(net, laid, begins, lengths)[0][0])
            sums += (net.embedding[words[at : at + step]] @ net.language).sum(0)
        guess = int(np.argmax(sums / len(words) + net.language_bias))
        return np.array([np.max(tops, axis=0) @ net.output + net.output_bias]), np.array([guess])
    laid, begins, lengths = _laid_out(words, counts)
    return _forward(net, laid, begins, lengths)[1], guessed_language(net, laid, begins, counts)


def toxicity(docs: DataFrame, labels: DataFrame, *, max_rows: int | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs (doc_id, text, optional lang)``.

    Labels count only outside the held-out part; labels that are null or neither 0 nor 1, labels of unknown
    documents and null texts teach nothing; of repeated labels the larger counts. With one class only, every score
    is the smoothed share of that class. Every different text of a repeated id teaches; with ``max_rows`` only a sample
    does (:func:`training_rows`). Null, empty and wordless texts get the score of a text without words. A null
    id is held out. Repeated rows stay as many rows; an empty table gives an empty table.
    """
    net = train(docs, labels, max_rows)
    scored = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), net, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, *, max_rows: int | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with all their columns.

    What teaches is as in :func:`toxicity`. Null and empty texts are judged like a text without words, a null id by its
    text; repeated rows are judged alike; an empty table stays empty.
    """
    names = docs.columns
    # a column of the same name as one of the results gets out of the way for the scoring
    held = [f"__c{i}" for i in range(len(names))]
    moved = docs.select(*[F.col(f"`{n}`").alias(h) for n, h in zip(names, held)], "text")
    scored = score_texts(moved, train(docs, labels, max_rows), held)
    return scored.filter("predicted = 0").select(*[F.col(h).alias(n) for n, h in zip(names, held)])
