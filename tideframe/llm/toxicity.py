"""Toxic spans by a linear-chain conditional random field.

1. Over all labelled training texts (equal texts count once) Spark counts, for
   every word and every word beginning of 4 to 6 bytes, the texts of either
   label that hold it. Those far more frequent in toxic texts are the lexicon,
   each with its smoothed log-odds.
2. Words of the lexicon in toxic texts are labelled T, all others O, and a CRF
   with two states is fitted on a bounded sample of texts: its observations are
   the log-odds of a word and of its neighbours, its transitions are learned.
3. Forward-backward gives each word's probability of T; weighted by the
   log-odds, their sum and maximum are the document's features, and a logistic
   fit on the same sample turns these into the score. Words of probability one half or more form the spans.

Far from lexicon words the chain is in its steady state, so messages are only
computed near them: within ``REACH`` words, or as many as the fitted chain needs
to forget where it started to one part in 10^9.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.graph import keep
from tideframe.llm.wordhash import ALNUM, LOWER, hash_spans, mix, texts, word_spans

#: Largest lexicon, and texts of either label that the CRF and the score are fitted on.
LEXICON, SAMPLE = 8192, 4000
BEGINNINGS = (4, 5, 6)
REACH = 48


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of their beginnings, one array for each kind."""
    low = LOWER[data]
    starts, ends, first = word_spans(ALNUM[low], offs)
    kinds = [hash_spans(low, starts, ends)]
    for n in BEGINNINGS:
        kinds.append(mix(hash_spans(low, starts, np.minimum(ends, starts + n)) + np.uint64(n)))
    return kinds, first, starts, ends


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False), bool)
        for lo, hi, data, offs in texts(batch.column("text")):
            kinds, first, _, _ = _features(data, offs)
            held: list[list[np.ndarray]] = [[], []]
            for d in range(hi - lo):
                own = np.concatenate([k[first[d] : first[d + 1]] for k in kinds])
                held[int(toxic[lo + d])].append(np.unique(own))
            both = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in held]
            keys, at = np.unique(np.concatenate(both), return_inverse=True)
            counts = [np.bincount(a, minlength=len(keys)) for a in (at[: len(both[0])], at[len(both[0]) :])]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts[0], pa.int64()), pa.array(counts[1], pa.int64())], ["feature", "clean", "toxic"])


class Lexicon:
    """Log-odds by feature hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.some = np.zeros(1 << 16, bool)
        self.some[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def value(self, kinds: list[np.ndarray]) -> np.ndarray:
        """Largest log-odds of each word's features, 0 without any."""
        out = np.zeros(len(kinds[0]))
        if len(self.keys):
            for kind in kinds:
                maybe = np.flatnonzero(self.some[(kind >> np.uint64(48)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, kind[maybe]), len(self.keys) - 1)
                same = self.keys[at] == kind[maybe]
                np.maximum.at(out, maybe[same], self.values[at[same]])
        return out


def learn_lexicon(labelled: DataFrame, n: dict[bool, int], size: int = LEXICON) -> Lexicon:
    """From (text, toxic), ``n`` texts of either label: features of at least 5 texts whose share of toxic ones is far above the base rate."""
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    base = n1 / (n1 + n0)
    counts = labelled.mapInArrow(_count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    z = (F.col("t") - (F.col("c") + F.col("t")) * base) / F.sqrt((F.col("c") + F.col("t")) * (base * (1 - base)))
    odds = F.log((F.col("t") + 0.5) / (F.col("c") + 0.5) * (n0 / n1))
    best = counts.filter((F.col("c") + F.col("t") >= 5) & (z >= 8) & (F.col("t") >= 4 * F.col("c"))).select("feature", odds.alias("odds"), z.alias("z"))
    rows = best.orderBy(F.desc("z"), "feature").limit(size).collect()
    return Lexicon(np.array([r["feature"] for r in rows], np.int64).view(np.uint64), np.array([r["odds"] for r in rows], float))


def sparse_words(array: pa.Array, lexicon: Lexicon) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its words, and positions, log-odds, first and last byte of those in the lexicon."""
    for lo, hi, data, offs in texts(array):
        kinds, first, starts, ends = _features(data, offs)
        value = lexicon.value(kinds)
        at = np.flatnonzero(value)
        cut = np.searchsorted(at, first)
        for d in range(hi - lo):
            own = at[cut[d] : cut[d + 1]]
            yield int(first[d + 1] - first[d]), own - first[d], value[own], starts[own] - offs[d], ends[own] - offs[d]


@dataclass
class Segments:
    """Neighbourhoods of lexicon words, padded to one length."""

    doc: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    x: np.ndarray  # segment, word, observation
    opens: np.ndarray
    closes: np.ndarray


#: Words that are padded into one array at most, and segments that the CRF is fitted on with their greatest length.
AREA, FIT_SEGMENTS, FIT_WORDS = 200_000, 2000, 200


def neighbourhoods(docs: list[tuple[int, np.ndarray, np.ndarray]], reach: int = REACH) -> list[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """(document, first word, end, words of the document, lexicon places from the first word, log-odds)."""
    found = []
    for d, (n, at, value) in enumerate(docs):
        if len(at):
            breaks = np.flatnonzero(np.diff(at) > 2 * reach) + 1
            for group, odds in zip(np.split(at, breaks), np.split(value, breaks), strict=True):
                a, b = max(0, int(group[0]) - reach), min(n, int(group[-1]) + reach + 1)
                found.append((d, a, b, n, group - a, odds))
    return found


def pieces(found: list[tuple[int, int, int, int, np.ndarray, np.ndarray]], words: int) -> list[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """Neighbourhoods cut so that none has more words; at a cut the messages are those of the steady state."""
    out = []
    for d, a, b, n, at, odds in found:
        for lo in range(a, b, words):
            hi = min(b, lo + words)
            own = (at + a >= lo) & (at + a < hi)
            out.append((d, lo, hi, n, at[own] + a - lo, odds[own]))
    return out


def segments(found: list[tuple[int, int, int, int, np.ndarray, np.ndarray]]) -> Iterator[Segments]:
    """Packed by length, so that padding stays small. Observations: 1, whether in the lexicon, log-odds, and those of both neighbours."""
    found = sorted(found, key=lambda s: s[2] - s[1])
    lo = 0
    while lo < len(found):
        hi = lo + 1
        while hi < len(found) and (hi + 1 - lo) * (found[hi][2] - found[hi][1]) <= AREA:
            hi += 1
        part = found[lo:hi]
        v = np.zeros((len(part), part[-1][2] - part[-1][1] + 2))
        for i, (_, _, _, _, at, odds) in enumerate(part):
            v[i, at + 1] = odds
        mid = v[:, 1:-1]
        x = np.stack([np.ones_like(mid), mid > 0, mid, v[:, :-2], v[:, 2:]], axis=2)
        yield Segments(np.array([s[0] for s in part]), np.array([s[1] for s in part]), np.array([s[2] - s[1] for s in part]), x, np.array([s[1] == 0 for s in part]), np.array([s[2] == s[3] for s in part]))
        lo = hi


@dataclass
class Crf:
    """Emission weights of T against O, transition scores [from, to], start score of T."""

    emit: np.ndarray
    move: np.ndarray
    start: float

    def steady(self) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward messages in the midst of words outside the lexicon."""
        e, a = np.array([1.0, np.exp(self.emit[0])]), np.exp(self.move)
        f, b = np.ones(2) / 2, np.ones(2) / 2
        for _ in range(500):
            f, b = (f @ a) * e, a @ (e * b)
            f, b = f / f.sum(), b / b.sum()
        return f, b

    def reach(self, rest: float = 1e-9) -> int:
        """Words outside the lexicon after which a message has forgotten all but ``rest`` of where it started, REACH at least."""
        least, most = np.sort(np.abs(np.linalg.eigvals(np.exp(self.move) * np.array([1.0, np.exp(self.emit[0])]))))
        ratio = min(least / most, 1 - 1e-6)
        return max(REACH, int(np.ceil(np.log(rest) / np.log(ratio))) if ratio > 0 else 0)

    def messages(self, s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward messages, backward messages and emissions of each segment's words."""
        m, width, _ = s.x.shape
        e = np.ones((m, width, 2))
        e[:, :, 1] = np.exp(np.clip(s.x @ self.emit, -50, 50))
        a = np.exp(self.move)
        calm_f, calm_b = self.steady()
        f, b = np.empty((m, width, 2)), np.empty((m, width, 2))
        now = np.where(s.opens[:, None], np.array([1.0, np.exp(self.start)]), calm_f @ a)
        for t in range(width):
            now = now * e[:, t]
            now /= now.sum(axis=1, keepdims=True)
            f[:, t] = now
            now = now @ a
        last = np.where(s.closes[:, None], np.ones(2), calm_b)
        now = last.copy()
        for t in range(width - 1, -1, -1):
            now = np.where((t >= s.length - 1)[:, None], last, now)
            now = now / now.sum(axis=1, keepdims=True)
            b[:, t] = now
            now = (now * e[:, t]) @ a.T
        return f, b, e

    def marginals(self, s: Segments) -> np.ndarray:
        """Probability of T for each segment's words; padding has 0."""
        f, b, _ = self.messages(s)
        p = f * b
        p = p[:, :, 1] / p.sum(axis=2)
        return np.where(np.arange(p.shape[1]) < s.length[:, None], p, 0)


def _gradient(crf: Crf, s: Segments, y: np.ndarray) -> np.ndarray:
    """Of the log-likelihood: observed less expected counts of emissions, transitions and starts."""
    real = np.arange(s.x.shape[1]) < s.length[:, None]
    both = real[:, 1:] & real[:, :-1]
    seen = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
    f, b, e = crf.messages(s)
    p = f * b
    p = np.where(real, p[:, :, 1] / p.sum(axis=2), 0)
    pair = f[:, :-1, :, None] * np.exp(crf.move) * (e[:, 1:] * b[:, 1:])[:, :, None, :]
    pair = pair / pair.sum(axis=(2, 3), keepdims=True)
    gap = np.where(real, y - p, 0)
    return np.concatenate([np.einsum("mt,mtk->k", gap, s.x), (seen - (pair * both[:, :, None, None]).sum(axis=(0, 1))).ravel(), [(gap[:, 0] * s.opens).sum()]])


def fit_crf(parts: list[Segments], tags: list[np.ndarray], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by gradient steps with Adam; ``tags`` marks the words labelled T."""
    total = sum(len(s.length) for s in parts)
    theta, first, second = np.zeros(10), np.zeros(10), np.zeros(10)
    crf = Crf(theta[:5], theta[5:9].reshape(2, 2), 0.0)
    for step in range(1, rounds + 1):
        grad = sum(_gradient(crf, s, y) for s, y in zip(parts, tags, strict=True)) / total - decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        crf = Crf(theta[:5], theta[5:9].reshape(2, 2), float(theta[9]))
    return crf


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (weight * (y - p)) - ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    crf: Crf
    score: np.ndarray

    def documents(self, docs: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Features of each document for the score, and the probabilities of its lexicon words."""
        own: list[list[tuple[int, np.ndarray]]] = [[] for _ in docs]
        for s in segments(neighbourhoods(docs, self.crf.reach())):
            p = self.crf.marginals(s)
            for i, d in enumerate(s.doc):
                at = docs[d][1]
                inside = at[(at >= s.begin[i]) & (at < s.begin[i] + s.length[i])]
                own[d].append((s.begin[i], p[i, inside - s.begin[i]]))
        tagged = [np.concatenate([p for _, p in sorted(x, key=lambda y: y[0])]) if x else np.zeros(0) for x in own]
        weight = [x * v for x, (_, _, v) in zip(tagged, docs, strict=True)]
        return np.array([[1.0, np.log1p(x.sum()), x.max(initial=0.0)] for x in weight]).reshape(-1, 3), tagged

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.score, -40, 40)))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, key, toxic) of the training texts; equal texts once, toxic if any of them is."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key")).filter(F.col("text").isNotNull() & ~held_out())
    return own.join(known.hint("merge"), "doc_id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, lexicon_size: int = LEXICON, sample: int = SAMPLE) -> Model:
    """Learn from labelled rows that are not held out; without any every score is one half.

    Whole texts are shuffled once, to meet their labels for the counts; the
    sample is named first and found by a broadcast of its at most ``2 * sample`` ids.
    """
    labelled = keep(labelled_texts(docs, labels))
    n = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull() & ~held_out())
    lexicon = learn_lexicon(whole.join(labelled.select("doc_id", "toxic").hint("merge"), "doc_id").select("text", "toxic"), n, lexicon_size)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(lexicon)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(sparse_words(batch.column("text"), shared.value))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["toxic", "n", "at", "value"]
            )

    chosen = [r for k in (True, False) for r in labelled.filter(F.col("toxic") == F.lit(k)).orderBy("key", "doc_id").limit(sample).select("doc_id", "toxic").collect()]
    named = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "doc_id long, toxic boolean")
    rows = whole.join(F.broadcast(named), "doc_id").select("text", "toxic").mapInArrow(reduce, "toxic boolean, n long, at array<long>, value array<double>").collect()
    y = np.array([r["toxic"] for r in rows], float)
    held = [(r["n"], np.array(r["at"], np.int64), np.array(r["value"], float)) for r in rows]
    model = Model(lexicon, Crf(np.array([-6.0, 0, 0, 0, 0]), np.zeros((2, 2)), 0.0), np.zeros(3))
    found = pieces(neighbourhoods(held), FIT_WORDS)
    # evenly over the sample, which is in the order of a hash within either label
    found = [found[i * len(found) // FIT_SEGMENTS] for i in range(FIT_SEGMENTS)] if len(found) > FIT_SEGMENTS else found
    if found:
        parts = list(segments(found))
        model.crf = fit_crf(parts, [(s.x[:, :, 1] > 0) * y[s.doc][:, None] for s in parts])
    if len(y):
        features, _ = model.documents(held)
        drawn = [max(1, int((y == k).sum())) for k in (0, 1)]
        weight = np.where(y == 1, n.get(True, 0) / drawn[1], n.get(False, 0) / drawn[0])
        model.score = fit_logistic(features, y, weight / weight.mean())
    return model


def _apply(model: Model, array: pa.Array) -> Iterator[tuple[float, list[dict]]]:
    rows: list = []

    def flush() -> Iterator[tuple[float, list[dict]]]:
        features, own = model.documents([r[:3] for r in rows])
        for r, score, p in zip(rows, model.scores(features), own, strict=True):
            yield float(score), [{"start": int(r[3][i]), "end": int(r[4][i]), "probability": float(p[i])} for i in np.flatnonzero(p >= 0.5)]
        rows.clear()

    for row in sparse_words(array, model.lexicon):
        rows.append(row)
        if len(rows) >= 512:
            yield from flush()
    if rows:
        yield from flush()


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, spans for every row of ``docs`` (doc_id, text, ...).

    score is the probability of label 1; spans are the words tagged toxic as
    ranges of the text's UTF-8 bytes with their marginal probability. Null and
    empty texts have no words and get the score of such. Repeated rows get equal
    results, other columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in batches:
            rows = list(_apply(shared.value, batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], kind)], ["doc_id", "held_out", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, spans array<struct<start:long,end:long,probability:double>>"
    )


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold.

    Null and empty texts score as texts without words; a score of the threshold
    is above it; repeated rows go or stay together; an empty table stays empty.
    """
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score < threshold for score, _ in _apply(shared.value, batch.column(text))], pa.bool_()))

    # by place, as names may have dots
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)
