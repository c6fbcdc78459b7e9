"""Language identification by words, backing off to character n-grams.

Every word of every training text is counted by language, and so are the n-grams
of one to four characters of the words. A known word scores by its log frequency
in each language; an unseen one by the n-grams it has of the greatest length of
which any is known. Words and n-grams are named by 64-bit hashes.

The model that every task holds is bounded: the commonest words and n-grams over
all languages, each with its counts in every language. Words beyond it keep
their counts in a table; what texts have of them is joined to it, so their
scores are the same as if the model held them. N-grams beyond it count as unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.graph import filter_slots, id_filter, keep, passes
from tideframe.llm.wordhash import hash_spans, mix

#: Counts (of a word or n-gram in a language) that the model holds at most, for words and for each length of n-grams.
WORD_ROWS, GRAM_ROWS, ORDERS = 500_000, 500_000, (4, 3, 2, 1)
#: What a language that lacks a word or n-gram counts it as.
FLOOR = 0.5
#: Characters of a slice of texts (one text at least).
SLICE = 1 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@cache
def _letters() -> np.ndarray:
    """By code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@dataclass
class Words:
    """The words of some texts: code points, where words start and end, their hashes, and each text's first word."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    first: np.ndarray

    def take(self, at: np.ndarray) -> Words:
        return Words(self.codes, self.starts[at], self.ends[at], self.keys[at], np.array([0, len(at)]))

    def strings(self) -> list[str]:
        return [self.codes[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(self.starts, self.ends, strict=True)]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of every n-gram of the words with ``^`` before and ``$`` behind them."""
        size = self.ends - self.starts + 2
        cut = np.cumsum(size) - size
        flat = np.full(int(size.sum()), ord("^"), np.uint64)
        word = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(flat)) - cut[word]
        inside = (at > 0) & (at < size[word] - 1)
        flat[inside] = self.codes[(self.starts[word] + at - 1)[inside]]
        flat[at == size[word] - 1] = ord("$")
        begin = np.flatnonzero(at + n <= size[word])
        out = np.full(len(begin), n, np.uint64)
        for k in range(n):
            out = mix(out ^ flat[begin + k]) if k % 2 == 0 else out ^ (flat[begin + k] << np.uint64(32))
        return word[begin], mix(out)


def words_of(texts: list[str | None]) -> Words:
    """Words are the runs of letters of the lower-cased texts."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = np.concatenate([[False], _letters()[codes], [False]])
    edges = np.flatnonzero(is_letter[1:] != is_letter[:-1])
    starts, ends = edges[::2], edges[1::2]
    offs = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    return Words(codes, starts, ends, hash_spans(codes.view(np.uint8), 4 * starts, 4 * ends), np.searchsorted(starts, offs))


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    texts, lo, size = column.to_pylist(), 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE or i == len(texts) - 1:
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0


def _counter(names: list[str]):
    """(code, key, count) of words and n-grams by slice; a code is eight times the place of the language in ``names`` and the length, 0 for words."""
    place = {x: i for i, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column("lang").to_pylist()
            for lo, texts in _slices(batch.column("text")):
                words = words_of(texts)
                lang = np.repeat([place[x] for x in named[lo : lo + len(texts)]], np.diff(words.first))
                rows = []
                for k in np.unique(lang):
                    at = np.flatnonzero(lang == k)
                    _, one, n = np.unique(words.keys[at], return_index=True, return_counts=True)
                    some = words.take(at[one])
                    rows.append((8 * k, some.keys, n))
                    for order in ORDERS:
                        word, gram = some.grams(order)
                        keys, which = np.unique(gram, return_inverse=True)
                        rows.append((8 * k + order, keys, np.bincount(which, n[word], len(keys)).astype(np.int64)))
                if rows:
                    codes = np.concatenate([np.full(len(key), code, np.int32) for code, key, _ in rows])
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.concatenate([r[1] for r in rows]).view(np.int64)), pa.array(np.concatenate([r[2] for r in rows]))], ["code", "key", "count"])

    return count


class Table:
    """Log frequencies by key and language, for those that have the key; the others have ``floor``."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, n: np.ndarray, totals: np.ndarray, size: int):
        mass = np.log(totals + FLOOR * (size + 1))
        order = np.lexsort((lang, key))
        key, self.lang = key[order], lang[order]
        self.floor = np.log(FLOOR) - mass
        # what a language has above the floor
        self.value = (np.log(n[order] + FLOOR) - np.log(FLOOR)).astype(np.float64)
        self.keys, first = np.unique(key, return_index=True)
        self.begin = np.concatenate([first, [len(key)]]).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 without."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, out: np.ndarray, row: np.ndarray, place: np.ndarray, weight: np.ndarray) -> None:
        """Add to ``out`` (row, language) what the keys at ``place`` have above the floor, times weight."""
        n = self.begin[place + 1] - self.begin[place]
        each = np.repeat(np.arange(len(place)), n)
        at = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + self.begin[place][each]
        out += np.bincount(row[each] * out.shape[1] + self.lang[at], weight[each] * self.value[at], out.size).reshape(out.shape)


class Model:
    """Tables of words and of n-grams by length."""

    def __init__(self, langs: list[str], words: Table, grams: dict[int, Table]):
        self.langs, self.words, self.grams = langs, words, grams

    def backoff(self, words: Words) -> np.ndarray:
        """Scores (word, language) by the n-grams of the greatest length of which any is known; 0 without any."""
        out, left = np.zeros((len(words.keys), len(self.langs))), np.arange(len(words.keys))
        for n in ORDERS:
            if not len(left):
                break
            word, gram = words.take(left).grams(n)
            place = self.grams[n].find(gram)
            word, place = word[place >= 0], place[place >= 0]
            known = np.bincount(word, minlength=len(left))
            self.grams[n].add(out, left[word], place, 1 / known[word])
            out[left[known > 0]] += self.grams[n].floor
            left = left[known == 0]
        return out

    def score(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scores (text, language), and text, word and count of every distinct word of a text outside the model, which has its backoff)."""
        docs = len(words.first) - 1
        out, doc = np.zeros((docs, len(self.langs))), np.repeat(np.arange(docs), np.diff(words.first))
        place = self.words.find(words.keys)
        known = place >= 0
        self.words.add(out, doc[known], place[known], np.ones(int(known.sum())))
        out += np.bincount(doc[known], minlength=docs)[:, None] * self.words.floor
        at = np.flatnonzero(~known)
        _, one, which = np.unique(words.keys[at], return_index=True, return_inverse=True)
        pair, n = np.unique(doc[at] * max(1, len(one)) + which, return_counts=True)
        text, word = pair // max(1, len(one)), pair % max(1, len(one))
        some = self.backoff(words.take(at[one]))
        for lang in range(len(self.langs)):
            out[:, lang] += np.bincount(text, n * some[word, lang], docs)
        return out, text, at[one][word], n


@dataclass
class Learned:
    """The model, and of the words beyond it (key, seen), seen being (place, count) of each language that has the word, with a filter of their keys; None without any.

    ``totals`` are the counts by language of words and n-grams, ``sizes`` the numbers of distinct ones.
    """

    model: Model
    rare: DataFrame | None
    known: np.ndarray | None
    sizes: dict[int, int]
    totals: dict[int, np.ndarray]


def learn(docs: DataFrame, word_rows: int = WORD_ROWS, gram_rows: int = GRAM_ROWS) -> Learned:
    """From text and non-null lang of the rows that are not held out, all of them and every language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # those without a letter in any text are no languages of the model
    names = sorted(r[0] for r in known.filter(F.col("text").rlike(r"\p{L}")).select("lang").distinct().collect())
    own = known.filter(F.col("text").rlike(r"\p{L}")).mapInArrow(_counter(names), "code int, key long, count long").groupBy("code", "key").agg(F.sum("count").alias("count"))
    counts = keep(own.select(F.expr("code div 8").cast("int").alias("lang"), (F.col("code") % 8).alias("kind"), "key", "count"))
    totals = {k: np.zeros(len(names)) for k in (0, *ORDERS)}
    for kind, lang, n in counts.groupBy("kind", "lang").agg(F.sum("count")).collect():
        totals[kind][lang] = n
    # how common a key is over all languages, in quarters of a doubling
    rank = F.floor(4 * F.log2(F.sum("count"))).cast("int")
    keys = keep(counts.groupBy("kind", "key").agg(rank.alias("rank"), F.count("*").alias("langs")))
    least, sizes = {}, dict.fromkeys(totals, 0)
    held = dict.fromkeys(totals, 0)
    for r in keys.groupBy("kind", "rank").agg(F.sum("langs").alias("rows"), F.count("*").alias("keys")).orderBy("kind", F.desc("rank")).collect():
        held[r["kind"]] += r["rows"]
        sizes[r["kind"]] += r["keys"]
        if held[r["kind"]] <= (word_rows if r["kind"] == 0 else gram_rows):
            least[r["kind"]] = r["rank"]

    def table(kind: int) -> Table:
        own = counts.filter(F.col("kind") == kind)
        if held[kind] > (word_rows if kind == 0 else gram_rows):
            own = own.join(keys.filter((F.col("kind") == kind) & (F.col("rank") >= least.get(kind, 1 << 30))).select("key"), "key", "left_semi")
        found = own.select("lang", "key", "count").toArrow()
        key, lang, n = (found.column(c).to_numpy() for c in ("key", "lang", "count"))
        return Table(key.astype(np.int64).view(np.uint64), lang.astype(np.int32), n.astype(float), totals[kind], sizes[kind])

    rare = known = None
    if held[0] > word_rows:
        beyond = keys.filter((F.col("kind") == 0) & (F.col("rank") < least.get(0, 1 << 30))).select("key")
        rare = counts.filter("kind = 0").join(beyond, "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct("lang", "count")).alias("seen"))
        known = id_filter(beyond, "key", hashed=True)
    return Learned(Model(names, table(0), {n: table(n) for n in ORDERS}), rare, known, sizes, totals)


def _results(langs: list[str], totals: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, score) of each row of scores over ``n`` words; the first by name on ties."""
    if not langs:
        return ["und"] * len(n), np.zeros(len(n))
    best = totals.argmax(axis=1)
    p = np.exp((totals - totals.max(axis=1, keepdims=True)) / np.maximum(1.0, np.sqrt(n))[:, None])
    return [langs[b] if k else "und" for b, k in zip(best, n, strict=True)], np.where(n > 0, 1 / p.sum(axis=1), 0.0)


def identify(docs: DataFrame, learned: Learned) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, ...).

    lang_pred is a language of the model, or ``und`` with score 0 for texts that
    are null or have no letters; score is the softmax of the log-likelihoods
    over the root of the number of words. Ties go to the first language by name.
    Whole texts are read; repeated rows get equal results; other columns are
    ignored; an empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    shared, known = sc.broadcast(learned.model), sc.broadcast(learned.known)
    rare, partial, sizes, totals = learned.rare, learned.rare is not None, learned.sizes, learned.totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, texts in _slices(batch.column("text")):
                words = words_of(texts)
                sums, text, word, times = model.score(words)
                part, n = batch.slice(lo, len(texts)), np.diff(words.first)
                names, score = _results(model.langs, sums, n)
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())]
                if partial:
                    keys = words.keys[word].view(np.int64)
                    at = np.flatnonzero(passes(known.value, filter_slots(keys)))
                    fields = [pa.array(keys[at]), pa.array(words.take(word[at]).strings(), pa.string()), pa.array(times[at], pa.int64())]
                    missing = pa.StructArray.from_arrays(fields, ["key", "word", "n"])
                    # pairs come in the order of the texts
                    cut = pa.array(np.searchsorted(text[at], np.arange(len(texts) + 1)).astype(np.int32))
                    flat = pa.array((np.arange(len(texts) + 1) * sums.shape[1]).astype(np.int32))
                    columns += [pa.array(n, pa.int64()), pa.ListArray.from_arrays(flat, pa.array(sums.ravel())), pa.ListArray.from_arrays(cut, missing)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "n", "sums", "missing"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    if rare is None:
        return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
    wide = "doc_id long, held_out boolean, lang_pred string, score double, n long, sums array<double>, missing array<struct<key:long,word:string,n:long>>"
    rows = keep(rows.mapInArrow(run, wide).withColumn("row", F.monotonically_increasing_id()))

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a word of the table scores by its own counts, less its backoff."""
        model = shared.value
        for batch in batches:
            seen = batch.column("seen").combine_chunks() if isinstance(batch.column("seen"), pa.ChunkedArray) else batch.column("seen")
            flat, each = seen.flatten(), np.diff(seen.offsets.to_numpy())
            place = np.repeat(np.arange(len(seen)), each).astype(np.uint64)
            table, own = Table(place, flat.field("lang").to_numpy(), flat.field("count").to_numpy().astype(float), totals[0], sizes[0]), words_of(batch.column("word").to_pylist())
            out = np.tile(table.floor, (len(seen), 1))
            at = np.arange(len(seen))
            table.add(out, at, table.find(at.astype(np.uint64)), np.ones(len(seen)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array((out - model.backoff(own)).tolist(), pa.list_(pa.float64()))], ["key", "more"])

    each = rows.select("row", F.explode("missing").alias("m")).select("row", "m.key", "m.word", "m.n")
    found = each.groupBy("key").agg(F.min("word").alias("word")).join(rare, "key").mapInArrow(differences, "key long, more array<double>")
    met = each.join(found, "key")
    langs = len(learned.model.langs)
    if langs <= 64:
        sums = met.groupBy("row").agg(*(F.sum(F.col("n") * F.get("more", F.lit(i))).alias(f"s{i}") for i in range(langs)))
        sums = sums.select("row", F.array(*(f"s{i}" for i in range(langs))).alias("more"))
    else:
        sums = met.select("row", "n", F.posexplode("more").alias("at", "x")).groupBy("row", "at").agg(F.sum(F.col("n") * F.col("x")).alias("x"))
        sums = sums.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("more"))
    both = rows.join(sums, "row", "left").select("doc_id", "held_out", "n", F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda s, m: s + m)).alias("sums"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = shared.value.langs
        for batch in batches:
            totals = np.array(batch.column("sums").to_pylist(), float).reshape(len(batch), len(langs))
            names, score = _results(langs, totals, batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return both.mapInArrow(choose, "doc_id long, held_out boolean, lang_pred string, score double")
