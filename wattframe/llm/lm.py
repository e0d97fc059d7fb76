"""A log-bilinear language model, trained by noise-contrastive estimation, that scores whole texts."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import batches_of, stored
from .common import split_words, strong_hashes, word_ids

#: Number of the end of a text (also what stands before its start); classes of words follow, then words.
END = 0
#: Bytes at the end of a word that name its class.
SUFFIX = 3
CONTEXT = 2
ADD = 0.1
#: Most rows of a context that are trained in one batch for being neighbours.
TOGETHER = 4
#: Most numbers of a model whose scores and normalisers are tabled (three tables of their square).
MOST_TABLED = 2048


class Vocabulary(NamedTuple):
    words: list[bytes]  # numbered from 1 + classes
    classes: int  # numbered from 1; of words that have no number of their own
    counts: np.ndarray  # training tokens by number
    tokens: int  # N
    types: int  # V


def classes_of(words: list[bytes], classes: int) -> np.ndarray:
    """The class of each word, by its last bytes, so that a word never seen in training has one too."""
    ends: dict[bytes, int] = {}
    which = np.array([ends.setdefault(w[-SUFFIX:], len(ends)) for w in words], np.int64)
    return (strong_hashes(ends)[:, 0] % np.uint64(classes)).astype(np.int64)[which]


def numbers_of(words: list[bytes], number: dict[bytes, int], classes: int) -> np.ndarray:
    """The model's number of each word: its own, or that of its class."""
    own = np.array([number.get(w, 0) for w in words], np.int64)
    return np.where(own > 0, own, 1 + classes_of(words, classes))


class Model(NamedTuple):
    """Score of word ``w`` after ``h``: ``target[w] . sum(position[i] * context[h[i]]) + bias[w]``."""

    context: np.ndarray
    target: np.ndarray
    position: np.ndarray
    bias: np.ndarray


# ---- the model, in numpy -------------------------------------------------------------


def initial(counts: np.ndarray, size: int, seed: int = 1) -> Model:
    random = np.random.default_rng(seed)
    n = len(counts)
    bias = np.log((counts + 1) / (counts.sum() + n))
    return Model(
        random.normal(0, 0.1, (n, size)), random.normal(0, 0.1, (n, size)), np.ones((CONTEXT, size)), bias
    )


def predicted(model: Model, before: np.ndarray) -> np.ndarray:
    return sum(model.position[i] * model.context[before[:, i]] for i in range(CONTEXT))


def train(
    model: Model, before: np.ndarray, word: np.ndarray, count: np.ndarray, noise: np.ndarray,
    seed: int, rate: float = 0.1, batch: int = 1024, samples: int = 256,
) -> Model:
    """One pass over counted (context, word) rows by noise-contrastive estimation with AdaGrad steps.

    A batch shares ``samples`` words drawn from the noise distribution; the model learns to tell the
    true word from them, without normalising.  A row weighs as much as it counts.

    Neighbouring rows of one context go into a batch together, so that its scores of the noise words are taken once.

    The bias is the target's last column, against a 1 in the prediction.  Sigmoids of the noise words are taken as
    (1 + tanh(x / 2)) / 2: the matrix products need the tanh alone, the rest is sums of their other factor.
    """
    random = np.random.default_rng(seed)
    n, size = model.target.shape
    context, position = model.context.astype(np.float32), model.position.astype(np.float32)
    target = np.concatenate([model.target, model.bias[:, None]], axis=1).astype(np.float32)
    of_position = np.full_like(position, 1e-8)
    steps = [(p, np.zeros_like(p), np.full_like(p, 1e-8), np.empty_like(p)) for p in (context, target)]
    cumulated, log_noise = np.cumsum(noise), np.log(samples * noise).astype(np.float32)
    order, group = _dealt(before, random)
    before, word = before[order], word[order]
    weight = (count / count.mean()).astype(np.float32)[order]
    places = np.arange(size + 1)
    r_all, h_all = np.ones((batch, size + 1), np.float32), np.empty((batch, samples), np.float32)
    for at in range(0, len(word), batch):
        w, g, own = word[at : at + batch], weight[at : at + batch], group[at : at + batch]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        first, own = np.flatnonzero(new), np.cumsum(new) - 1
        h = before[at : at + batch][first]
        g = (g / np.float32(len(g)))[:, None]
        half_g = np.add.reduceat(g, first, axis=0) / np.float32(2)
        drawn = np.minimum(np.searchsorted(cumulated, random.random(samples)), n - 1)
        inputs = [context.take(h[:, i], axis=0) for i in range(CONTEXT)]
        r, half = r_all[: len(h)], h_all[: len(h)]
        r[:, :size] = sum(position[i] * inputs[i] for i in range(CONTEXT))
        r_of, of_true, of_drawn = r.take(own, axis=0), target.take(w, axis=0), target.take(drawn, axis=0)
        shifted = of_drawn / np.float32(2)
        shifted[:, size] -= log_noise[drawn] / np.float32(2)
        np.tanh(np.matmul(r, shifted.T, out=half), out=half)
        d_true = g * _sigmoid(log_noise[w] - np.einsum("ij,ij->i", r_of, of_true))[:, None]
        weighted = half_g * r
        d_r = np.add.reduceat(d_true * of_true, first, axis=0) - half_g * (half @ of_drawn + of_drawn.sum(axis=0))
        d_r = d_r[:, :size]
        d_drawn = -(half.T @ weighted + weighted.sum(axis=0))
        for i in range(CONTEXT):
            _add(steps[0][1], h[:, i], d_r * position[i], places)
        _add(steps[1][1], w, d_true * r_of, places)
        _add(steps[1][1], drawn, d_drawn, places)
        for parameter, step, square, work in steps:
            np.multiply(step, step, out=work)
            square += work
            np.sqrt(square, out=work)
            step *= np.float32(rate)
            step /= work
            parameter += step
            step.fill(0)
        step = np.stack([np.einsum("ij,ij->j", d_r, inputs[i]) for i in range(CONTEXT)])
        of_position += step * step
        position += np.float32(rate) * step / np.sqrt(of_position)
    return Model(*(p.astype(np.float64) for p in (context, target[:, :size], position, target[:, size])))


def _dealt(before: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """All rows in random order, but for runs of up to TOGETHER neighbours of one context, which stay together, and each one's run."""
    same = np.all(before[1:] == before[:-1], axis=1)
    edge = np.flatnonzero(np.concatenate([[True], ~same])[: len(before)])
    place = np.arange(len(before)) - np.repeat(edge, np.diff(np.append(edge, len(before))))
    first = np.flatnonzero(place % TOGETHER == 0)
    sizes = np.diff(np.append(first, len(before)))
    turn = random.permutation(len(first))
    first, sizes = first[turn], sizes[turn]
    group = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(before)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes), group


def _add(total: np.ndarray, at: np.ndarray, rows: np.ndarray, places: np.ndarray) -> None:
    """Add the rows to those of ``total`` by number."""
    size = rows.shape[1]
    np.add.at(total.reshape(-1), (at[:, None] * size + places[:size]).reshape(-1), rows.reshape(-1))


def noise_of(counts: np.ndarray) -> np.ndarray:
    """The noise distribution: training counts, flattened so that rare words are drawn too."""
    flat = (counts + 1) ** 0.75
    return flat / flat.sum()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40), dtype=x.dtype))


class Tables(NamedTuple):
    """Parts of all scores and the normalisers of all contexts: ``scores[i][h[i], w]`` add up to the score of ``w`` after ``h``."""

    scores: list[np.ndarray]  # the bias is in the first
    total: np.ndarray  # logarithm of the sum over the vocabulary, by the two numbers of a context


def tables_of(model: Model) -> Tables | None:
    """The tables of a model of up to MOST_TABLED numbers, in whose squares their size is; else None.

    A score is a sum of a part for each word of the context, so the sum over the vocabulary of its exponentials is a
    product of two matrices: all contexts together cost what some thousands of them do one by one.
    """
    n = len(model.bias)
    if n > MOST_TABLED:
        return None
    scores = [(model.position[i] * model.context) @ model.target.T for i in range(CONTEXT)]
    scores[0] += model.bias
    most = [s.max(axis=1) for s in scores]
    sums = np.exp(scores[0] - most[0][:, None]) @ np.exp(scores[1] - most[1][:, None]).T
    far = np.argwhere(sums < 1e-200)  # the largest parts stand at words so unlike that their product vanishes
    total = np.log(np.maximum(sums, 1e-200)) + most[0][:, None] + most[1]
    for a, b in far:
        both = scores[0][a] + scores[1][b]
        total[a, b] = both.max() + np.log(np.exp(both - both.max()).sum())
    return Tables(scores, total)


def log_probabilities(
    model: Model, before: np.ndarray, word: np.ndarray, batch: int = 4096, tables: Tables | None = None
) -> np.ndarray:
    """Natural logarithm of the normalised probability of each word in its context.

    Read off the model's tables, if given; else the sum over the vocabulary is taken once for each distinct context, as
    matrix products of batches.
    """
    if tables is not None:
        found = np.empty(len(word))
        for at in range(0, len(word), 1 << 16):
            first, second, w = before[at : at + (1 << 16), 0], before[at : at + (1 << 16), 1], word[at : at + (1 << 16)]
            found[at : at + (1 << 16)] = tables.scores[0][first, w] + tables.scores[1][second, w] - tables.total[first, second]
        return found
    n = len(model.bias)
    contexts, which = np.unique(before[:, 0] * n + before[:, 1], return_inverse=True)
    small = Model(*(p.astype(np.float32) for p in model))
    r = np.empty((len(contexts), model.target.shape[1]), np.float32)
    total = np.empty(len(contexts))
    for at in range(0, len(contexts), batch):
        part = contexts[at : at + batch]
        r[at : at + batch] = predicted(small, np.stack([part // n, part % n], axis=1))
        scores = r[at : at + batch] @ small.target.T + small.bias
        most = scores.max(axis=1)
        total[at : at + batch] = most + np.log(np.exp(scores - most[:, None]).sum(axis=1, dtype=np.float64))
    found = np.empty(len(word))
    for at in range(0, len(word), 1 << 16):
        w, c = word[at : at + (1 << 16)], which[at : at + (1 << 16)]
        found[at : at + (1 << 16)] = np.einsum("ij,ij->i", r[c], small.target[w]) + small.bias[w] - total[c]
    return found


# ---- texts as numbers ----------------------------------------------------------------


def _packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows ``id, held, text`` as stored rows of many texts each (``block``), about ``block_bytes`` of text; no shuffle."""
    id_type = docs.schema["id"].dataType.simpleString()

    def pack(batches):
        ids, held, texts, size = [], [], [], 0

        def row():
            return pa.RecordBatch.from_pydict({
                "ids": pa.array([ids], pa.list_(id_arrow)), "held": pa.array([held], pa.list_(pa.bool_())),
                "texts": pa.array([texts], pa.list_(pa.string())),
            })

        for batch in batches:
            id_arrow = batch.schema.field("id").type
            for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("id", "held", "text"))):
                ids.append(i)
                held.append(h)
                texts.append(t or "")
                size += len(texts[-1]) if texts[-1].isascii() else len(texts[-1].encode())
                if size >= block_bytes:
                    yield row()
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield row()

    packed = docs.select("id", "held", "text").mapInArrow(
        pack, f"ids array<{id_type}>, held array<boolean>, texts array<string>"
    )
    return stored(packed.withColumn("block", F.monotonically_increasing_id()), "lm-texts", large_rows=True)


def _block_words(texts: list, held: list):
    """Words of a block, their numbers in it, its distinct words, and for each word whether its text trains."""
    words = split_words([t.encode() for t in texts], lower=True)
    ids, distinct = word_ids(words)
    trains = ~np.asarray(held, bool)
    _, offsets, data = distinct.buffers()  # cut here, as to_pylist makes a scalar of each word
    edges = np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1].tolist() if len(distinct) else [0]
    joined = data.to_pybytes() if len(distinct) else b""
    return words, ids, [joined[a:b] for a, b in zip(edges[:-1], edges[1:])], trains


def _buckets_of(distinct: list[bytes], buckets: int) -> np.ndarray:
    return (strong_hashes(distinct)[:, 0] % np.uint64(buckets)).astype(np.int64)


def _tokens(words, numbers: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Model numbers of all tokens, ends included, the CONTEXT numbers before each (last first), and the text of each."""
    sizes = np.diff(words.first) + 1
    ends = np.cumsum(sizes) - 1
    token = np.full(sizes.sum(), END, np.int64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = numbers
    before = np.full((len(token), CONTEXT), END, np.int64)
    of = np.repeat(np.arange(texts), sizes)
    for i in range(CONTEXT):
        same = of[i + 1 :] == of[: len(of) - i - 1]
        before[i + 1 :, i][same] = token[: len(token) - i - 1][same]
    return token, before, of


# ---- counting, training, scoring on Spark --------------------------------------------


def count_words(packed: DataFrame, buckets: int, top: int, classes: int) -> DataFrame:
    """Training counts of every word, stored as rows of three kinds.

    ``block, bucket, counts``: for each block that sent its distinct words of a bucket, their counts over
    all blocks, in the order sent.  ``word, n``: the ``top`` words of each bucket.  ``types, n``: distinct words
    and tokens of a bucket, with both by class as its payload.  A word costs a block one entry however often it stands there.
    """

    def send(batches):
        for batch in batches:
            for block, texts, held in zip(*(batch.column(c).to_pylist() for c in ("block", "texts", "held"))):
                words, ids, distinct, trains = _block_words(texts, held)
                counts = np.bincount(ids, trains[words.text_of].astype(float), len(distinct)).astype(np.uint32)
                of = _buckets_of(distinct, buckets)
                order = np.argsort(of, kind="stable")
                edge = np.searchsorted(of[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edge))
                parts = [order[edge[k] : edge[k + 1]] for k in full]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(full, pa.int64()), "block": pa.array([block] * len(full), pa.int64()),
                    "words": pa.array([b"\n".join([distinct[i] for i in p.tolist()]) for p in parts], pa.binary()),
                    "counts": pa.array([counts[p].tobytes() for p in parts], pa.binary()),
                })

    def add(table: pa.Table) -> pa.Table:
        sent = [w.split(b"\n") for w in table["words"].to_pylist()]
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(w, len(number)) for words in sent for w in words], np.int64)
        own = np.concatenate([np.frombuffer(c, np.uint32) for c in table["counts"].to_pylist()])
        total = np.bincount(which, own, len(number)).astype(np.int64)
        edge = np.cumsum([0] + [len(words) for words in sent])
        names = list(number)
        best = np.lexsort((np.array(names, object).argsort().argsort(), -total))[:top]
        best = best[total[best] > 0]
        rows, more = len(sent), len(best)
        of = classes_of(names, classes)
        by_class = np.stack([np.bincount(of, total, classes), np.bincount(of, total > 0, classes)]).astype(np.int64)
        return pa.table({
            "kind": pa.array([0] * rows + [1] * more + [2], pa.int32()),
            "block": pa.array(table["block"].to_pylist() + [None] * (more + 1), pa.int64()),
            "bucket": pa.array(table["bucket"].to_pylist() + [None] * (more + 1), pa.int64()),
            "payload": pa.array(
                [total[which[a:b]].tobytes() for a, b in zip(edge[:-1], edge[1:])] + [names[i] for i in best.tolist()] + [by_class.tobytes()],
                pa.binary(),
            ),
            "n": pa.array([None] * rows + total[best].tolist() + [int(total.sum())], pa.int64()),
            "types": pa.array([None] * (rows + more) + [int((total > 0).sum())], pa.int64()),
        })

    sent = packed.mapInArrow(send, "bucket long, block long, words binary, counts binary")
    return stored(sent.groupBy("bucket").applyInArrow(
        add, "kind int, block long, bucket long, payload binary, n long, types long"
    ), "lm-counts")


def count_contexts(packed: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per block, the distinct (context, word) numbers of its training texts and how often each occurs, stored."""
    number = {w: i + 1 + vocabulary.classes for i, w in enumerate(vocabulary.words)}
    n = len(number) + 1 + vocabulary.classes

    def count(batches):
        for batch in batches:
            for block, texts, held in zip(*(batch.column(c).to_pylist() for c in ("block", "texts", "held"))):
                words, ids, distinct, trains = _block_words(texts, held)
                numbers = numbers_of(distinct, number, vocabulary.classes)[ids]
                token, before, of = _tokens(words, numbers, len(texts))
                del words, ids, distinct, numbers  # one of a block's arrays is as large as its text
                key = before[:, 0] * n
                key += before[:, 1]
                key *= n
                key += token
                key = key[trains[of]]
                del token, before, of
                keys, counts = np.unique(key, return_counts=True)
                gaps = np.diff(keys, prepend=0).astype(np.int64)
                planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int64()), "keys": pa.array([planes.tobytes()], pa.binary()),
                    "counts": pa.array([counts.astype(np.uint32).tobytes()], pa.binary()),
                })

    return stored(packed.mapInArrow(count, "block long, keys binary, counts binary"), "lm-contexts", large_rows=True)


def fit(contexts: DataFrame, vocabulary: Vocabulary, size: int, rounds: int) -> Model:
    """Parameters trained in every task from the same start on its own rows, then averaged by their tokens; ``rounds`` times.

    Averages are summed by parameter in Spark; the driver holds one model, whose size does not depend on the corpus.
    """
    n = len(vocabulary.counts)
    model = initial(vocabulary.counts, size)
    noise = noise_of(vocabulary.counts)
    if vocabulary.counts.sum() == 0:
        return model

    for turn in range(rounds):
        start = Model(*model)

        def learn(batches, start=start, turn=turn):
            total, tokens = None, 0
            for batch in batches:
                for block, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "counts"))):
                    count = np.frombuffer(counts, np.uint32).astype(float)
                    if not len(count):
                        continue
                    gaps = np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, -1).T).reshape(-1).view(np.int64)
                    key = np.cumsum(gaps)
                    before = np.stack([key // n // n, key // n % n], axis=1)
                    own = train(start, before, key % n, count, noise, seed=int(block % 2**31) * 31 + turn)
                    flat = np.concatenate([p.reshape(-1) for p in own]) * count.sum()
                    total, tokens = (flat if total is None else total + flat), tokens + count.sum()
            if total is not None:
                chunks = np.array_split(np.append(total, tokens), 16)
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array(range(16), pa.int32()), "part": pa.array([c.tobytes() for c in chunks], pa.binary()),
                })

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(p, np.float64) for p in table["part"].to_pylist())
            return pa.table({"chunk": table["chunk"][:1], "part": pa.array([total.tobytes()], pa.binary())})

        schema = "chunk int, part binary"
        rows = contexts.mapInArrow(learn, schema).groupBy("chunk").applyInArrow(add, schema).collect()
        flat = np.concatenate([np.frombuffer(r["part"], np.float64) for r in sorted(rows, key=lambda r: r["chunk"])])
        flat, at, parts = flat[:-1] / flat[-1], 0, []
        for p in model:
            parts.append(flat[at : at + p.size].reshape(p.shape))
            at += p.size
        model = Model(*parts)
    return model


def _summed_classes(counts: DataFrame, classes: int) -> np.ndarray:
    """Training tokens and distinct words of every class; partial sums are formed in the tasks."""

    def add(batches):
        total = np.zeros(2 * classes, np.int64)
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                total += np.frombuffer(payload, np.int64)
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(2 * classes), pa.int32()), "n": pa.array(total)})

    parts = counts.where("kind = 2").select("payload").mapInArrow(add, "place int, n long")
    total = np.zeros(2 * classes)
    for row in parts.groupBy("place").agg(F.sum("n").alias("n")).collect():
        total[row["place"]] = row["n"]
    return total.reshape(2, classes)


def score_texts(
    docs: DataFrame, top: int = 1000, size: int = 24, rounds: int = 2, block_bytes: int = 8 << 20, classes: int = 256,
) -> DataFrame:
    """Scores of rows ``id, text, held``; the rows not held train.

    Tokens are the words (A-Z lowered, runs of other than ASCII white space) and one end per text.
    ``base_score`` is the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))) with the training counts c, their
    sum N and number V.  ``score`` is the model's log10 probability of the text: a log-bilinear model of the two
    tokens before gives normalised probabilities of the ``top`` training words, the end, and ``classes`` classes of
    all other words, by their last SUFFIX bytes; the words of a class share its vector, as target and as context, and its
    probability by their counts, smoothed in the same way.  So every word has a vector, and all probabilities add up to 1.

    Counts, vocabulary and contexts are gathered from all training texts: every block of texts sends its
    distinct words to their buckets and gets their counts back, and its distinct contexts, counted, are what the
    model trains on.  A null text counts as empty: one token, the end.  Without training rows all counts are 0.
    """
    with batches_of(docs.sparkSession, block_bytes):
        packed = _packed(docs, block_bytes)
        train_texts, size_sum = packed.select(
            F.sum(F.size(F.filter("held", lambda h: ~h))).alias("n"),
            F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t))).alias("bytes"),
        ).first()
        train_texts = train_texts or 0
        buckets = int((size_sum or 0) // (4 << 20)) + 1
        counts = count_words(packed, buckets, top, classes)
        best = counts.where("kind = 1").orderBy(F.desc("n"), "payload").limit(top).select("payload", "n").collect()
        sums = counts.where("kind = 2").agg(F.sum("n"), F.sum("types")).first()
        tokens, types = (sums[0] or 0) + train_texts, (sums[1] or 0) + bool(train_texts)
        known = np.array([r["n"] for r in best], np.int64)
        names = [bytes(r["payload"]) for r in best]
        of_class = _summed_classes(counts, classes) - np.stack([
            np.bincount(classes_of(names, classes), w, classes) for w in (known, np.ones(len(names)))
        ])
        vocabulary = Vocabulary(names, classes, np.concatenate([[train_texts], of_class[0], known]).astype(float), tokens, types)
        model = fit(count_contexts(packed, vocabulary), vocabulary, size, rounds)
    number = {w: i + 1 + classes for i, w in enumerate(vocabulary.words)}
    id_type = docs.schema["id"].dataType.simpleString()
    tables = []  # filled once in each task

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, held, texts = (block[c][0].as_py() for c in ("ids", "held", "texts"))
        words, word, distinct, _ = _block_words(texts, held)
        of_bucket = _buckets_of(distinct, buckets)
        order = np.argsort(of_bucket, kind="stable")
        c = np.zeros(len(distinct))
        replies = sorted(zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist()))
        c[order] = np.frombuffer(b"".join(p for _, p in replies), np.int64)
        numbers = numbers_of(distinct, number, classes)
        token, before, of = _tokens(words, numbers[word], len(texts))
        sizes = np.diff(words.first) + 1
        inner = np.ones(len(token), bool)
        inner[np.cumsum(sizes) - 1] = False
        count = np.full(len(token), float(train_texts))
        count[inner] = c[word]
        del words, word, distinct, numbers, inner, c
        base = np.log10((count + ADD) / (tokens + ADD * (types + 1)))
        if not tables:
            tables.append(tables_of(model))
        found = log_probabilities(model, before, token, tables=tables[0]) / math.log(10)
        outside = (token > END) & (token <= classes)
        own_tokens, own_types = of_class[:, token[outside] - 1]
        found[outside] += np.log10((count[outside] + ADD) / (own_tokens + ADD * (own_types + 1)))
        total = lambda values: np.bincount(of, values, len(texts))
        return pa.table({
            "id": block["ids"].combine_chunks().flatten(),
            "held_out": pa.array(held, pa.bool_()),
            "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(total(count > 0).astype(np.int64), pa.int64()),
            "train_tokens": pa.array([tokens] * len(texts), pa.int64()),
            "base_score": pa.array(total(base), pa.float64()),
            "score": pa.array(total(found), pa.float64()),
        })

    answers = counts.where("kind = 0").select("block", "bucket", "payload")
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score,
        f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
