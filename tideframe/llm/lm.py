"""Masked pseudo-likelihood by a bidirectional window network.

Spark counts every word of every text; the commonest words have an id of their
own, the others share ``BUCKETS`` ids by hash. The network sees the ``SIDE`` words
on either side of a place, never the word itself: the embeddings of these (one
table for each offset) are added, squashed, and give a softmax over word classes
times one over the words of a class. It is trained data-parallel: texts are put
in groups by a hash, whatever the partitions they come in; every group takes
gradient steps over its own texts from common weights, the weights are averaged
by Spark in a fixed order, and the next round goes on from there. A text's
score is the sum over all its words of the log-probability given both sides; a
word that shares an id has the probability of the id times its own share of the
id's count, so every word of the corpus is told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.graph import keep
from tideframe.llm.wordhash import ALNUM, texts, word_hashes

CLASSES, IN_CLASS, BUCKETS = 32, 32, 64
VOCABULARY = CLASSES * IN_CLASS
SIDE, WIDTH, BATCH = 2, 16, 1024
#: Rounds of averaging; in round r the places r, r + STRIDE, ... of every text are predicted. A stride of more than the rounds is cut to them, so that every place is.
ROUNDS, STRIDE, RATE = 2, 2, 0.15
BLOCK = 1024
#: Places that are scored together.
TOGETHER = 4096
#: Bytes of text of a group that is trained on by one task, and groups at most.
GROUP_BYTES, GROUPS = 16 << 20, 4096
#: Words with a shared id whose counts every task has; the counts of rarer ones are joined. Parts of a logarithm that are summed as whole numbers, so that equal rows get equal sums.
SHARED, UNIT = 65_536, 1 << 24


class Network:
    """Weights in one flat array, so that they can be averaged in blocks."""

    SHAPES = {"embed": (2 * SIDE, VOCABULARY + 1, WIDTH), "classes": (CLASSES, WIDTH), "class_bias": (CLASSES,), "words": (CLASSES, IN_CLASS, WIDTH), "word_bias": (CLASSES, IN_CLASS)}

    def __init__(self, flat: np.ndarray | None = None, seed: int = 1):
        size = sum(int(np.prod(s)) for s in self.SHAPES.values())
        if flat is None:
            flat = np.random.Generator(np.random.PCG64(seed)).normal(0, 0.05, size).astype(np.float32)
        self.flat = flat
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.embed[0][context[:, 0]]
        for o in range(1, 2 * SIDE):
            h = h + self.embed[o][context[:, o]]
        return np.tanh(h)

    def _words(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order of the rows by class, where each class begins, sorted hidden rows, logits in the class, word in the class)."""
        kind = (target // IN_CLASS).astype(np.uint16)
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        cut, h = np.searchsorted(kind, np.arange(CLASSES + 1)), h[order]
        logits = np.empty((len(h), IN_CLASS), h.dtype)
        for c in np.flatnonzero(np.diff(cut)):
            np.matmul(h[cut[c] : cut[c + 1]], self.words[c].T, out=logits[cut[c] : cut[c + 1]])
        logits += self.word_bias[kind]
        return order, cut, h, logits, (target % IN_CLASS)[order]

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        h = self.hidden(context)
        out = _log_softmax(h @ self.classes.T + self.class_bias)[np.arange(len(target)), target // IN_CLASS]
        order, _, _, logits, word = self._words(h, target)
        out[order] += _log_softmax(logits)[np.arange(len(word)), word]
        return out

    def step(self, context: np.ndarray, target: np.ndarray, memory: Network, rate: float) -> None:
        """One Adagrad step on the mean log-probability; ``memory`` holds the squares. Embeddings that no place asks for stay as they are."""
        n = len(target)
        h = self.hidden(context)
        gap = _gap(h @ self.classes.T + self.class_bias, target // IN_CLASS)
        grad = {"classes": gap.T @ h, "class_bias": gap.sum(axis=0), "words": np.zeros_like(self.words), "word_bias": np.zeros_like(self.word_bias)}
        back = gap @ self.classes
        order, cut, rows, logits, word = self._words(h, target)
        gap, inner, some = _gap(logits, word), np.empty_like(rows), np.flatnonzero(np.diff(cut))
        for c in some:
            lo, hi = cut[c], cut[c + 1]
            np.matmul(gap[lo:hi].T, rows[lo:hi], out=grad["words"][c])
            np.matmul(gap[lo:hi], self.words[c], out=inner[lo:hi])
        grad["word_bias"][some] = np.add.reduceat(gap, cut[some], axis=0)
        back[order] += inner
        back *= 1 - h * h
        # the rows of all offsets' tables at once; small whole numbers are sorted by their digits
        ids = (context + np.arange(2 * SIDE) * (VOCABULARY + 1)).T.ravel().astype(np.uint16)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        own, g = ids[first], np.add.reduceat(back[order % n], first, axis=0) / n
        table, held = self.embed.reshape(-1, WIDTH), memory.embed.reshape(-1, WIDTH)
        square = held[own] + g * g
        held[own] = square
        table[own] += rate * g / (np.sqrt(square) + 1e-6)
        for name, g in grad.items():
            g = g / n
            square = getattr(memory, name)
            square += g * g
            weights = getattr(self, name)
            weights += rate * g / (np.sqrt(square) + 1e-6)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _gap(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What is wanted (1 at ``at``) less the probabilities of logits, which are used up."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= -x.sum(axis=1, keepdims=True)
    x[np.arange(len(x)), at] += 1
    return x


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offs in texts(batch.column("text")):
            words, _, _, _ = word_hashes(data, offs, ALNUM)
            keys, n = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): hash and count of every word over all texts."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> np.ndarray:
    """Hashes of the commonest words over all texts, commonest first; at most VOCABULARY - BUCKETS."""
    return _commonest(word_counts(docs))


def _commonest(counts: DataFrame) -> np.ndarray:
    rows = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - BUCKETS).collect()
    return np.array([r[0] for r in rows], np.int64).view(np.uint64)


class Shares:
    """Log shares of words in the count of their bucket, as far as the words are known here."""

    def __init__(self, buckets: np.ndarray, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.buckets, self.keys, self.logs = np.log(np.maximum(buckets, 1)), words[order], np.log(counts[order])

    def __call__(self, words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what to add to the log-probability of each word, places whose log count is still missing in it)."""
        out = np.zeros(len(words))
        at = np.flatnonzero(ids >= VOCABULARY - BUCKETS)
        out[at] = -self.buckets[ids[at] - (VOCABULARY - BUCKETS)]
        if not len(self.keys):
            return out, at
        to = np.minimum(np.searchsorted(self.keys, words[at]), len(self.keys) - 1)
        same = self.keys[to] == words[at]
        out[at[same]] += self.logs[to[same]]
        return out, at[~same]


def _shares(counts: DataFrame, words: np.ndarray, most: int) -> tuple[Shares, DataFrame]:
    """Shares with the ``most`` commonest words outside ``words`` at most, and (word, n) of all others."""
    own = [int(w) for w in words.view(np.int64)]
    rest = counts.filter(~F.col("word").isin(own)) if own else counts
    buckets = np.zeros(BUCKETS)
    for b, n in rest.groupBy(F.col("word").bitwiseAND(F.lit(BUCKETS - 1).cast("long"))).agg(F.sum("n")).collect():
        buckets[b] = n
    held, least = 0, None
    for r in rest.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        least = r["n"] + 1 if least is None else least
        held += r["words"]
        if held > most:
            break
        least = r["n"]
    known = rest.filter(F.col("n") >= (least or 1)).toArrow()
    keys = known.column("word").to_numpy().astype(np.int64).view(np.uint64)
    return Shares(buckets, keys, known.column("n").to_numpy()), rest.filter(F.col("n") < (least or 1))


class Encoder:
    """Ids of words: ranks of the vocabulary, then buckets by hash."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words)
        self.keys = words[self.order]

    def ids(self, words: np.ndarray) -> np.ndarray:
        out = (VOCABULARY - BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64)).astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
            same = self.keys[at] == words
            out[same] = self.order[at[same]]
        return out

    def contexts(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context ids of every word, its own id); places beyond a text have the id VOCABULARY."""
        ids, n = self.ids(words), len(words)
        count = np.diff(first)
        low, high = np.repeat(first[:-1], count), np.repeat(first[1:], count)
        at, out = np.arange(n), np.full((n, 2 * SIDE), VOCABULARY)
        for o, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
            inside = (at + shift >= low) & (at + shift < high)
            out[inside, o] = ids[at[inside] + shift]
        return out, ids


def _mean(table: pa.Table) -> pa.Table:
    """The mean of one block's weights, added up in the order of the groups."""
    table = table.sort_by("place")
    seen = table.column("seen").to_numpy().astype(float)
    held = table.column("w").combine_chunks().flatten().to_numpy().reshape(len(seen), -1)
    mean = (held * seen[:, None]).sum(axis=0) / seen.sum()
    return pa.table({"block": table.column("block").slice(0, 1), "w": pa.array([mean.astype(np.float32)], pa.list_(pa.float32()))})


def train(docs: DataFrame, words: np.ndarray, rounds: int = ROUNDS, stride: int = STRIDE, rate: float = RATE) -> Network:
    """Weights averaged over all groups, by the places each has predicted; the same for the same rows."""
    sc = docs.sparkSession.sparkContext
    text = F.col("text").cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = int(min(GROUPS, max(1, -(-size // GROUP_BYTES))))
    by = F.xxhash64(F.col("doc_id").cast("long"), text)
    own = docs.filter(text.isNotNull()).select(by.alias("by"), text.alias("text")).repartition(groups, "by").sortWithinPartitions("by", "text").select("text")
    encoder, network = sc.broadcast(Encoder(words)), Network()
    stride = max(1, min(stride, rounds))
    for r in range(rounds):
        start = sc.broadcast(network.flat)

        def learn(batches: Iterator[pa.RecordBatch], start=start, r=r) -> Iterator[pa.RecordBatch]:
            net, memory, seen = Network(start.value.copy()), Network(np.full_like(start.value, 1e-3)), 0
            for batch in batches:
                for _, _, data, offs in texts(batch.column("text")):
                    hashes, first, _, _ = word_hashes(data, offs, ALNUM)
                    context, target = encoder.value.contexts(hashes, first)
                    place = np.arange(len(target)) - np.repeat(first[:-1], np.diff(first))
                    pick = np.flatnonzero(place % stride == r % stride)
                    # texts of a partition are mixed, so that a step does not see one alone
                    pick = pick[np.argsort(hashes[pick] ^ np.uint64(0x5555555555555555) * (pick.astype(np.uint64) + np.uint64(1)), kind="stable")]
                    for lo in range(0, len(pick), BATCH):
                        part = pick[lo : lo + BATCH]
                        net.step(context[part], target[part], memory, rate)
                    seen += len(pick)
            if seen:
                cut = np.append(np.arange(0, len(net.flat), BLOCK), len(net.flat))
                n, lists = len(cut) - 1, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(net.flat))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([seen] * n, pa.int64()), lists], ["block", "place", "seen", "w"]
                )

        # a block at a time, a row for each group, so that no task or driver holds the weights of many
        parts = own.mapInArrow(learn, "block int, place int, seen long, w array<float>")
        rows = parts.groupBy("block").applyInArrow(_mean, "block int, w array<float>").orderBy("block").collect()
        if not rows:
            break
        network = Network(np.concatenate([np.array(b["w"], np.float32) for b in rows]))
    return network


def score(docs: DataFrame, words: np.ndarray, network: Network, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob, perplexity for every row of ``docs`` (doc_id, text, ...).

    log_prob is the sum over all words of the natural log-probability given both
    sides. With ``counts`` (word, n) each word outside ``words`` has its share of
    its bucket's probability, one that ``counts`` lacks that of a single
    occurrence; without, it has the whole bucket's. Null and empty texts have no
    words, log_prob 0, and null means. Repeated rows get equal results; other
    columns are ignored; an empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    known, rare = (None, None) if counts is None else _shares(counts, words, SHARED)
    encoder, shared, shares = sc.broadcast(Encoder(words)), sc.broadcast(network.flat), sc.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value)
        for batch in batches:
            counts, sums, missing, lengths = [], [], [], []
            for _, _, data, offs in texts(batch.column("text")):
                hashes, first, _, _ = word_hashes(data, offs, ALNUM)
                context, target = encoder.value.contexts(hashes, first)
                logs = np.zeros(len(target) + 1)
                for lo in range(0, len(target), TOGETHER):
                    logs[lo + 1 : lo + TOGETHER + 1] = net.log_probs(context[lo : lo + TOGETHER], target[lo : lo + TOGETHER])
                at = np.zeros(0, int)
                if shares.value is not None:
                    more, at = shares.value(hashes, target)
                    logs[1:] += more
                # in whole units, which doubles add up exactly; logs[0] is the empty sum
                total = np.cumsum(np.round(logs * UNIT)) / UNIT
                counts.append(np.diff(first))
                sums.append(total[first[1:]] - total[first[:-1]])
                missing.append(hashes[at])
                lengths.append(np.diff(np.searchsorted(at, first)))
            n, log = (np.concatenate(x) if x else np.zeros(0) for x in (counts, sums))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([[0], *lengths])), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *missing]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(log, pa.float64()), lists], ["doc_id", "n_tokens", "log_prob", "missing"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, log_prob double, missing array<long>")
    if rare is not None:
        out = keep(out.withColumn("row", F.monotonically_increasing_id()))
        units = F.round(F.log(F.coalesce("n", F.lit(1)).cast("double")) * UNIT).cast("long")
        more = out.select("row", F.explode("missing").alias("word")).join(rare, "word", "left").groupBy("row").agg((F.sum(units) / UNIT).alias("more"))
        out = out.drop("missing").join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE) -> DataFrame:
    """Count, train and score; see ``score`` for the result."""
    counts = keep(word_counts(docs))
    words = _commonest(counts)
    return score(docs, words, train(docs, words, rounds, stride), counts)
