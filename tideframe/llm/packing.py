"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised in Arrow tasks and cut into pieces. How pieces are packed
depends on their lengths alone, and there are no more lengths than tokens in a
sequence: Spark counts the pieces of each length, the driver packs these counts
and Spark deals the pieces of a length out to the places planned for it. A bin
that best-two-fit fills is filled the same way again for as long as the counts
allow, so it is planned once with a number of copies: the plan has as many entries
for a thousand pieces as for a billion, and it is the plan that packing all of
them one bin at a time would give.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.graph import keep

LIMIT, END = 4096, 1
#: Bytes of text that a task tokenises at a time (one document at least), and words whose ids it remembers.
SLICE_BYTES, KNOWN_WORDS = 10 << 20, 1_000_000
#: Pieces of a length that one task ranks in a large table.
TASK_ROWS = 200_000
_RANK_BITS = 46


class Words:
    """Token ids of texts by a tokenizer whose tokens never span ASCII white space.

    Each distinct run of other characters is tokenised once and looked up after
    that: all new ones are normalised and cut as one text, and each distinct cut
    goes to the model. What is remembered, as flat arrays, is bounded; when it is
    full it starts anew.
    """

    def __init__(self, definition: str, most: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(definition), most
        # special tokens, and white space that is not ASCII
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", *map(re.escape, special)])
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.cuts = all(len(cut(f"{a}{b}{b}")) == 2 for a in "aé1" for b in ".,;:!?")
        self.lowers = self.tokenizer.normalizer.normalize_str("AZ") == "az"
        self._forget()

    def _forget(self) -> None:
        self.known, self.size, self.pool, self.parts = pa.array([""], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.int32), {}

    def _tokenised(self, new: pa.Array) -> list[list[int]]:
        """The ids of each word; those that hold special tokens or other white space go through the whole tokenizer."""
        odd = pc.match_substring_regex(new, self.odd)
        # a letter stands for each of them meanwhile, as white space is put together
        words: list[str] = pc.if_else(odd, "x", new).to_pylist()
        out: list[list[int]] = [[] for _ in words]
        normal = self.tokenizer.normalizer.normalize_str(" ".join(words))
        model, parts = self.tokenizer.model, self.parts
        # where the space behind each word stands
        until = iter([m.start() for m in re.finditer(" ", normal)] + [len(normal)])
        ids, end, lists = [], -1, iter(out)
        for part, (begin, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
            while begin > end:
                end, ids = next(until), next(lists)
            own = parts.get(part)
            if own is None:
                own = parts[part] = [t.id for t in model.tokenize(part)]
            ids += own
        if pc.any(odd).as_py():
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            for i, e in zip(at, self.tokenizer.encode_batch(new.take(pa.array(at)).to_pylist(), add_special_tokens=False), strict=True):
                out[i] = e.ids
        if len(parts) > self.most // 8:
            parts.clear()
        return out

    def _add(self, new: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, new])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Remember words, and where: those that end in a few common marks behind a letter or digit as two, and plain ones in lower case if the tokenizer lowers them."""
        if self.cuts:
            halves = pc.extract_regex(new, r"^(?P<core>.*[\p{L}\p{N}])(?P<tail>[.,;:!?]+)$")
            core = pc.if_else(halves.is_valid(), pc.struct_field(halves, "core"), new)
            core = pc.if_else(pc.match_substring_regex(core, "^[A-Za-z]+$"), pc.ascii_lower(core), core) if self.lowers else core
            tail = pc.fill_null(pc.struct_field(halves, "tail"), "")
        else:
            core, tail = new, pa.array([""] * len(new), pa.string())
        coded = pa.concat_arrays([core, tail]).dictionary_encode()
        places = pc.index_in(coded.dictionary, self.known)
        fresh = places.is_null()
        at = pc.fill_null(places, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if places.null_count:
            at[fresh.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(places.null_count)
            plain = coded.dictionary.filter(fresh)
            lists = self._tokenised(plain)
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            self._add(plain, size, np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(size.sum())))
        both = at[coded.indices.to_numpy()].reshape(2, -1).T
        out = both[:, 0].copy()
        other = pc.not_equal(core, new)
        if pc.any(other).as_py():
            rows = other.to_numpy(zero_copy_only=False)
            out[rows] = len(self.known) + np.arange(int(rows.sum()))
            pairs = both[rows]
            self._add(new.filter(other), self.size[pairs].sum(axis=1), self._ids_of(pairs.ravel())[0])
        return out

    def _ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of known words one after the other, where each begins and, last, the end)."""
        each = self.size[codes]
        after = np.concatenate(([0], np.cumsum(each)))
        shift = (np.cumsum(self.size) - self.size)[codes] - after[:-1]
        return self.pool[np.repeat(shift, each) + np.arange(after[-1])], after

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's begin and, last, the end)."""
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        if len(self.known) > self.most:
            self._forget()
        places = pc.index_in(coded.dictionary, self.known)
        at = pc.fill_null(places, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if places.null_count:
            fresh = places.is_null()
            at[fresh.to_numpy(zero_copy_only=False)] = self._learn(coded.dictionary.filter(fresh))
        ids, after = self._ids_of(at[coded.indices.to_numpy()])
        return ids, after[ends - ends[0]]


@lru_cache(maxsize=1)
def _words(definition: str) -> Words:
    """One for all tasks of a worker."""
    return Words(definition)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of documents of about SLICE_BYTES."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, before = 0, 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
        yield lo, hi
        lo, before = hi, size[hi - 1]


def _pieces_of(ids: np.ndarray, first: np.ndarray, limit: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids with ``end`` after each document, document, start and length of each piece)."""
    n = len(first) - 1
    own = np.diff(first)
    out = np.insert(ids.astype("<u4"), first[1:], end)
    total = own + 1
    count = -(-total // limit)
    doc = np.repeat(np.arange(n), count)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * limit
    return out, doc, start, np.minimum(limit, total[doc] - start)


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document.

    ``tokenizer`` is the path of a definition of the tokenizers library, read on
    the driver; its tokens must not span ASCII white space. A document is the ids
    of its whole text and ``end``; only longer ones than ``limit`` are cut. Null
    and empty texts are ``end`` alone; repeated rows and null ids are documents
    like others; other columns are ignored.
    """
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(definition.value)
        for batch in batches:
            names, whole = batch.column(0), pc.fill_null(batch.column(1), "")
            for lo, hi in _slices(whole):
                ids, first = words.ids(whole.slice(lo, hi - lo))
                out, doc, start, length = _pieces_of(ids, first, limit, end)
                at = np.concatenate(([0], np.cumsum(length)))
                crc = [zlib.crc32(out[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [names.slice(lo, hi - lo).take(pa.array(doc)), pa.array(start // limit, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def fill(have: list[int], left: np.ndarray, limit: int) -> dict[int, int]:
    """How many pieces of which length the next bin takes, by best-two-fit.

    ``have`` are the lengths there are, rising, ``left`` their numbers by length.
    Greedily the largest that fits goes in; then, as long as it leaves a smaller
    gap, the smallest one in the bin gives way to the two unpacked ones that
    together fill the gap it leaves best (of equal pairs the one with the longest).
    """
    taken: dict[int, int] = {}
    gap, i = limit, len(have) - 1
    while gap and (i := min(i, bisect_right(have, gap) - 1)) >= 0:
        n = min(int(left[have[i]]), gap // have[i])
        taken[have[i]] = n
        gap -= n * have[i]
        i -= 1
    lengths = np.array(have)
    while gap:
        least = min(taken)
        # all shorter than the gap are packed, and two that are longer than it fit only if both are shorter than the least
        some = lengths[bisect_right(have, gap) : bisect_right(have, least - 1)]
        free = left[some] - np.array([taken.get(int(x), 0) for x in some], np.int64) if len(some) else some
        some, free = some[free > 0], free[free > 0]
        if not len(some):
            break
        at = np.arange(len(some))
        other = np.minimum(np.searchsorted(some, gap + least - some, "right") - 1, at)
        other = np.where((other == at) & (free < 2), at - 1, other)
        sums = np.where(other >= 0, some + some[other], 0)
        best = len(sums) - 1 - int(np.argmax(sums[::-1]))
        if sums[best] <= least:
            break
        taken[least] -= 1
        if not taken[least]:
            del taken[least]
        for x in (int(some[best]), int(some[other[best]])):
            taken[x] = taken.get(x, 0) + 1
        gap += least - int(sums[best])
    return taken


def plan(counts: dict[int, int], limit: int = LIMIT) -> tuple[np.ndarray, int]:
    """(rows of length, first rank, pieces a sequence, first sequence, offset, in the order of lengths and ranks; number of sequences)."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    have = [int(x) for x in np.flatnonzero(left)]
    used, sequences, runs = np.zeros(limit + 1, np.int64), 0, []
    while have:
        bin_ = fill(have, left, limit)
        copies = min(int(left[x]) // n for x, n in bin_.items())
        offset = 0
        for x, n in sorted(bin_.items(), reverse=True):
            runs.append((x, int(used[x]), n, sequences, offset))
            used[x] += n * copies
            left[x] -= n * copies
            offset += n * x
            if not left[x]:
                have.remove(x)
        sequences += copies
    return np.array(sorted(runs), np.int64).reshape(-1, 5), sequences


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__rank``, which numbers the pieces of each length from 0.

    Parts of a length by ranges of a hash are numbered apart, and shifted by what
    lies before them, so that a length that very many pieces share is no one
    task's. Pieces equal in all that the order looks at are interchangeable.
    """
    bits = max(6, (rows.count() // TASK_ROWS).bit_length())
    hashed = rows.withColumn("__hash", F.xxhash64(F.lit("packing"), "doc_id", "piece", "ids_crc32"))
    parts = hashed.withColumn("__part", F.shiftrightunsigned("__hash", 64 - bits).cast("int"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("length", "__part").count()
    ahead = sums.select("length", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__ahead"))
    own = F.row_number().over(Window.partitionBy("length", "__part").orderBy("__hash", "doc_id", "piece", "ids_crc32"))
    return parts.withColumn("__own", own).join(ahead, ["length", "__part"]).select(*rows.columns, (F.col("__ahead") + F.col("__own") - 1).alias("__rank"))


def place(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``rows`` (doc_id, piece, ids_crc32, length and others; a kept table, read twice) with sequence_id and offset.

    The driver sees a count a length, ``limit`` at most. An empty table gives an
    empty result. A length beyond ``limit`` is refused.
    """
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    if counts and not 0 < min(counts) <= max(counts) <= limit:
        raise ValueError(f"lengths must be from 1 to {limit}")
    runs, _ = plan(counts, limit)
    shared = rows.sparkSession.sparkContext.broadcast(((runs[:, 0] << _RANK_BITS) + runs[:, 1], runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            _, first, each, sequence, offset = runs[np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1].T
            copy, at = np.divmod(rank - first, each)
            kept = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence + copy), pa.array(offset + at * length)], [*kept, "sequence_id", "offset"])

    ranked = _ranked(rows)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "__rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """Where every piece of every document goes: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Offsets leave no gap in a sequence. See ``pieces`` for nulls, empty texts and
    repeated rows; which of several equal pieces goes where makes no difference.
    """
    return place(keep(pieces(docs, tokenizer, limit, end, with_ids)), limit)


def sequences(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and the doc_ids and starts of the pieces within, in order.

    A sequence has at most ``limit`` ids, which bounds what is collected for it.
    """
    placed = pack(docs, tokenizer, limit, end, with_ids=True)
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = placed.groupBy("sequence_id").agg(held.alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
