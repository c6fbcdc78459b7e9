"""Benchmark decontamination by winnowing.

Both sides keep the smallest ``k``-gram hash of every ``window - k + 1``
neighbouring k-grams (the rightmost on ties). A run of ``window`` equal words
has the same k-grams on both sides, so both keep the same one of them: every
shared run of at least ``window`` words has a common fingerprint. Fingerprints
are joined, each hit is extended word by word along its diagonal, the words of
runs that reach a whole window are compared, and those that hold are reported.

The benchmark is a stated query set: items are cut into pieces that overlap by
one word less than a window, and read in blocks of a bounded number of words,
each broadcast to one pass over the documents. One block is the usual case; a
larger benchmark takes more passes, not more memory, and only hits are kept
between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.graph import forget, keep
from tideframe.llm.wordhash import ALNUM, LOWER, grams, texts, word_hashes

#: Words of a block and of a piece of an item.
BLOCK_WORDS, PIECE_WORDS = 2_000_000, 20_000


def _winnow(gram: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` grams, the position of the smallest, rightmost on ties."""
    n = len(gram) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = gram[span - 1 : span - 1 + n].copy()
    at = np.arange(span - 1, span - 1 + n)
    for j in range(span - 2, -1, -1):
        other = gram[j : j + n]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    return at


class _Index:
    """Fingerprints of one block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int, k: int):
        self.window, self.k = window, k
        self.words: list[np.ndarray] = []
        self.spelled: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        table: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        for _, _, data, offs in texts(pa.array([t for _, t in items], pa.large_string())):
            words, first, starts, ends = word_hashes(data, offs, ALNUM)
            low = LOWER[data]
            self.words += [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            self.spelled += [(low, starts[a:b], ends[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        self.ids = [i for i, _ in items]
        for i, words in enumerate(self.words):
            if len(words) >= window:
                gram = grams(words, k)
                for j in np.unique(_winnow(gram, window - k + 1)):
                    table.setdefault(int(gram[j]), []).append((i, int(j)))
            elif len(words):
                self.short.setdefault(len(words), {}).setdefault(int(grams(words, len(words))[0]), []).append(i)
        self.table = table
        self.keys = np.array(sorted(table), np.uint64)
        self.short_keys = {m: np.array(sorted(t), np.uint64) for m, t in self.short.items()}

    def _same(self, item: int, j: int, text: tuple[np.ndarray, np.ndarray, np.ndarray], p: int) -> bool:
        """Whether word j of the item is spelled as word p of the text."""
        (x, a, b), (y, c, d) = self.spelled[item], text
        return np.array_equal(x[a[j] : b[j]], y[c[p] : d[p]])

    def hits(self, words: np.ndarray, first: np.ndarray, text: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(document, first word, last word + 1, item) of every extended run; ``text``: lower-cased bytes and where words start and end."""
        count = len(first) - 1
        if not len(words):
            return
        doc_of = np.repeat(np.arange(count), np.diff(first))
        end = first[1:][doc_of]
        at = np.arange(len(words))
        if len(self.keys):
            gram = grams(words, self.k)
            chosen = _winnow(gram, self.window - self.k + 1)
            chosen = np.unique(chosen[(at[: len(chosen)] + self.window) <= end[: len(chosen)]])
            seen = set()
            for p in chosen[_in(gram[chosen], self.keys)]:
                d, p = int(doc_of[p]), int(p)
                for item, j in self.table[int(gram[p])]:
                    if (d, item, p - j) in seen:
                        continue
                    own = self.words[item]
                    lo, hi = max(-j, int(first[d]) - p), min(len(own) - j, int(first[d + 1]) - p)
                    equal = words[p + lo : p + hi] == own[j + lo : j + hi]
                    for a, b in _runs(equal, self.window):
                        equal[a:b] = [self._same(item, j + lo + i, text, p + lo + i) for i in range(a, b)]
                    for a, b in _runs(equal, self.window):
                        yield d, p + lo + a, p + lo + b, item
                    seen.add((d, item, p - j))
        for m, keys in self.short_keys.items():
            gram = grams(words, m)
            ok = (at[: len(gram)] + m) <= end[: len(gram)]
            for p in np.flatnonzero(ok & _in(gram, keys)).tolist():
                for item in self.short[m][int(gram[p])]:
                    if all(self._same(item, i, text, p + i) for i in range(m)):
                        yield int(doc_of[p]), p, p + m, item


def _runs(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Half-open runs of True of at least ``least`` places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]


def _in(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values if len(keys) else np.zeros(len(values), bool)


def _found(index: _Index, array: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
    """For each text: number of words, runs (unsorted) and items."""
    for lo, hi, data, offs in texts(array):
        words, first, starts, ends = word_hashes(data, offs, ALNUM)
        runs: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
        items: list[set[int]] = [set() for _ in range(hi - lo)]
        for d, a, b, item in index.hits(words, first, (LOWER[data], starts, ends)):
            runs[d].append((a - int(first[d]), b - int(first[d])))
            items[d].add(item)
        for d in range(hi - lo):
            yield int(first[d + 1] - first[d]), runs[d], items[d]


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open runs, sorted and disjoint; runs that touch are joined."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _pieces(bench: DataFrame, window: int, piece_words: int) -> DataFrame:
    """(item_id, piece, text, words): items of more than ``piece_words`` words cut into pieces that share all but no window."""
    step = max(1, piece_words - window + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            names = batch.column("item_id").to_pylist()
            for lo, hi, data, offs in texts(batch.column("text")):
                _, first, starts, ends = word_hashes(data, offs, ALNUM)
                for d in range(hi - lo):
                    n = int(first[d + 1] - first[d])
                    for k, a in enumerate(range(0, max(1, n - window + 1), step) if n > piece_words else ([0] if n else [])):
                        b = min(n, a + piece_words) if n > piece_words else n
                        raw = data[starts[first[d] + a] : ends[first[d] + b - 1]].tobytes().decode()
                        rows.append((names[lo + d], k, raw, b - a))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["item_id", "piece", "text", "words"])

    items = bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    # an item that is repeated is one
    return items.mapInArrow(cut, "item_id string, piece int, text string, words long").distinct()


def _blocks(pieces: DataFrame, window: int, k: int, block_words: int) -> Iterator[tuple[int, _Index]]:
    """(number of blocks, index) of one block after another."""
    n = int((pieces.agg(F.sum("words")).first()[0] or 0) // block_words) + 1
    block = F.pmod(F.xxhash64("item_id", "piece"), F.lit(n))
    for b in range(n):
        yield n, _Index([(r[0], r[1]) for r in pieces.filter(block == b).select("item_id", "text").collect()], window, k)


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_HITS = "n_words long, runs array<struct<first:long,end:long>>, items array<string>"


def _scanner(shared, all_rows: bool):
    """(k1, k2, doc_id, n_words, runs, items) of all rows, or of those with a run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            counts, runs, ids = [], [], []
            for n_words, found, items in _found(index, batch.column("text")):
                counts.append(n_words)
                runs.append([{"first": a, "end": b} for a, b in merge_runs(found)])
                ids.append(sorted({index.ids[i] for i in items}))
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("k1", "k2", "doc_id")), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(ids, pa.list_(pa.string()))],
                ["k1", "k2", "doc_id", "n_words", "runs", "items"],
            )
            yield out if all_rows else out.filter(pa.array([bool(r) for r in runs], pa.bool_()))

    return scan


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [[{"first": a, "end": b} for a, b in merge_runs([(x["first"], x["end"]) for x in own or []])] for own in batch.column("runs").to_pylist()]
        ids = [sorted(set(own or [])) for own in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(runs, _RUNS), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "n_words", "runs", "items"])


def _keys() -> list:
    """128 bits of a row's doc_id and text; rows equal in both have one result."""
    return [F.xxhash64(F.lit(k), F.col("doc_id").cast("long"), F.col("text").cast("string")).alias(f"k{k}") for k in (1, 2)]


def _later(rows: DataFrame, blocks: Iterator[tuple[int, _Index]]) -> DataFrame | None:
    """(k1, k2, runs, items) of the rows that blocks hit, each block's kept."""
    sc, found = rows.sparkSession.sparkContext, None
    for _, index in blocks:
        own = rows.mapInArrow(_scanner(sc.broadcast(index), False), f"k1 long, k2 long, doc_id long, {_HITS}")
        own = keep(own.select("k1", "k2", "runs", "items").distinct())
        found = own if found is None else found.union(own)
    return found


def benchmark_hits(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """doc_id, n_words, runs, items, contaminated for every row of ``docs`` (doc_id, text, ...).

    Words are the runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
    characters. ``runs`` are the half-open ranges of words inside an occurrence
    of ``window`` consecutive words of an item (of the whole item, if it is
    shorter); ``items`` the distinct ids of such items as sorted strings. Null
    and empty texts have no words and no hits; items with null id or text, or
    without words, hit nothing. Repeated rows each get their own result. Other
    columns are ignored; empty tables give empty results.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(*_keys(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = keep(_pieces(bench, window, piece_words))
    blocks = _blocks(pieces, window, k, block_words)
    n, index = next(blocks)
    out = rows.mapInArrow(_scanner(sc.broadcast(index), True), f"k1 long, k2 long, doc_id long, {_HITS}")
    if n > 1:
        more = _later(rows, blocks).groupBy("k1", "k2").agg(F.flatten(F.collect_list("runs")).alias("more"), F.flatten(F.collect_list("items")).alias("named"))
        both = lambda a, b: F.concat(a, F.coalesce(b, F.slice(a, 1, 0)))
        out = out.join(more, ["k1", "k2"], "left").select("doc_id", "n_words", both(F.col("runs"), F.col("more")).alias("runs"), both(F.col("items"), F.col("named")).alias("items")).mapInArrow(_merge, f"doc_id long, {_HITS}")
    forget(pieces)
    return out.select("doc_id", "n_words", "runs", "items", (F.size("runs") > 0).alias("contaminated"))


def without_benchmark(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no window of an item occurs.

    Null and empty texts hold none and stay, as does everything if there are no
    items; repeated rows go or stay together; items with null ids or texts count as none.
    """
    sc = docs.sparkSession.sparkContext
    pieces = keep(_pieces(bench, window, piece_words))
    blocks = _blocks(pieces, window, k, block_words)
    n, index = next(blocks)
    shared, text = sc.broadcast(index), docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not runs for _, runs, _ in _found(shared.value, batch.column(text))], pa.bool_()))

    # by place, as names may have dots
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    out = plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)
    if n > 1:
        rows = docs.select(*_keys(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        gone = _later(rows, blocks).select("k1", "k2").distinct()
        keyed = out.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_keys())
        out = keyed.join(gone, ["k1", "k2"], "left_anti").select("row.*")
    forget(pieces)
    return out
