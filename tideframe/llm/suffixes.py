"""Exact removal of repeated byte strings by a partitioned enhanced suffix array.

The suffixes of a corpus that share ``length`` bytes have to meet in one place.
Every window of that many bytes picks an anchor, the smallest hash of the
``GRAM``-byte strings in it; equal windows pick equal anchors at equal offsets, so
the anchor's hash partitions the suffix array and no equal windows are parted.
Neighbouring windows with one anchor form a run, and the run's bytes its context.

* The distinct contexts of one anchor are a part of the suffix array: their
  suffixes are sorted, the stack scan of the common-prefix lengths gives the tree
  of prefix intervals, and intervals of at least ``length`` bytes whose left
  neighbours differ are maximal repeats. Contexts that occur more than once stand
  for all their occurrences, which are listed with the group.
* Parts of more than ``PART`` contexts are cut finer: windows whose starts lie in
  the same ``STEP`` places before the anchor form a class, keyed by the bytes that
  all of them share, and each class is a part of its own with the same scan.
* Only where even a class has more than ``PART`` distinct contents, as in a hot
  passage with as many surroundings, are its windows grouped by a digest of 128
  bits, with map-side combine: the intervals of exactly ``length`` bytes.

Texts, contexts, classes and windows are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.decontaminate import merge_runs
from tideframe.llm.graph import keep
from tideframe.llm.wordhash import SLICE_BYTES, hash_spans, mix, texts

LENGTH, GRAM, PART, STEP = 200, 32, 256, 8
_PLACE = np.uint64((1 << 28) - 1)


_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of value(byte) * base^position over data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(len(data))[0], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hash of data[start:end] for each span, to choose anchors by; it says nothing of identity."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Smallest of key[i : i + width] for every i, by doubling."""
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def runs(data: np.ndarray, offs: np.ndarray, length: int, gram: int, named: bool = True) -> tuple[np.ndarray, ...]:
    """(document, first window start, last window start, anchor, anchor hash, two context hashes if ``named``) of every run."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (int, int, int, int, np.uint64, np.uint64, np.uint64))
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hashes(sums, at, at + gram)
    anchor = (_sliding_min((grams & ~_PLACE) | at.astype(np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(anchor)]
    ok = np.arange(len(anchor)) + length <= offs[1:][doc]
    start = np.flatnonzero(ok)
    if not len(start):
        return tuple(np.zeros(0, t) for t in (int, int, int, int, np.uint64, np.uint64, np.uint64))
    anchor, doc = anchor[start], doc[start]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((first[1:], [len(start)])) - 1
    lo, hi, a = start[first], start[last], anchor[first]
    if not named:
        return doc[first], lo, hi, a, grams[a], a, a
    shape = ((a - lo).astype(np.uint64) << np.uint64(32)) + (hi - lo).astype(np.uint64)
    context = [mix(c + mix(shape + np.uint64(k))) for k, c in enumerate((span_hashes(sums, lo, hi + length), hash_spans(data, lo, hi + length)))]
    return doc[first], lo, hi, a, grams[a], *context


def maximal_repeats(contexts: list[bytes], starts: list[int], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(common bytes, [(context, place)]) of every left-diverse prefix interval of at least ``length`` bytes.

    ``starts[i]`` suffixes of context i are in the array, at places 0, 1, ...; what
    stands before place 0 counts as different from all else.
    """
    suffixes = sorted(((i, p) for i, n in enumerate(starts) for p in range(n)), key=lambda s: contexts[s[0]][s[1] :])
    left = [contexts[i][p - 1] if p else -1 - k for k, (i, p) in enumerate(suffixes)]

    def common(x: tuple[int, int], y: tuple[int, int]) -> int:
        a, b = contexts[x[0]][x[1] :], contexts[y[0]][y[1] :]
        if a[:length] != b[:length]:
            return 0
        low, high = length, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
        return low

    stack: list[tuple[int, int]] = []  # common bytes, first suffix of the interval
    for k in range(1, len(suffixes) + 1):
        now, begin = (common(suffixes[k - 1], suffixes[k]) if k < len(suffixes) else 0), k - 1
        while stack and stack[-1][0] > now:
            shared, begin = stack.pop()
            if len(set(left[begin:k])) > 1:
                yield shared, suffixes[begin:k]
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, begin))


_TEXT = "t1 long, t2 long, bytes int"
_RUN = f"h long, c1 long, c2 long, {_TEXT}, lo int, more int, ahead int"


def _anchors(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c).to_numpy() for c in ("t1", "t2", "bytes")]
            for first, _, data, offs in texts(batch.column("text")):
                doc, lo, hi, a, h, c1, c2 = runs(data, offs, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (h, c1, c2)), *(pa.array(x[first + doc]) for x in own), *(pa.array(x.astype(np.int32)) for x in (lo - offs[doc], hi - lo, a - lo))],
                    ["h", "c1", "c2", "t1", "t2", "bytes", "lo", "more", "ahead"],
                )

    return find


def _anchor_hashes(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in texts(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(runs(data, offs, length, gram, named=False)[4].view(np.int64))], ["h"])

    return find


_WANTED = ["h", "c1", "c2", "lo", "more", "ahead"]


def _contexts(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c).to_pylist() for c in ("t1", "t2", "bytes")]
            for i, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True)):
                raw, n = text.as_buffer().to_pybytes(), len(wanted)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([w[c] for w in wanted], pa.int64() if c in ("h", "c1", "c2") else pa.int32()) for c in _WANTED),
                        pa.array([own[0][i]] * n, pa.int64()), pa.array([own[1][i]] * n, pa.int64()), pa.array([own[2][i]] * n, pa.int32()),
                        pa.array([raw[w["lo"] : w["lo"] + w["more"] + length] for w in wanted], pa.binary()),
                    ],
                    [*_WANTED, "t1", "t2", "bytes", "context"],
                )

    return cut


#: Columns of a span of a part: its group and the member's two keys, its text, its place there, and the span in the member.
_SPAN = f"part string, repeat int, k1 long, k2 long, {_TEXT}, lo int, start int, end int"
_PART = ["k1", "k2", "t1", "t2", "bytes", "lo", "more", "ahead", "context"]
#: Members of a part whose pairs are looked at before their suffixes are sorted.
FEW = 8


def _shared(a: bytes, b: bytes, back: bool) -> int:
    """Bytes that two strings share from their beginning, or back from their end."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        same = a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] if back else a[low:mid] == b[low:mid]
        low, high = (mid, high) if same else (low, mid - 1)
    return low


def may_repeat(contexts: list[bytes], ahead: list[int], length: int) -> bool:
    """Whether any two contexts share ``length`` bytes around their anchors (at ``ahead``); equal windows lie at one place from theirs, so no others repeat."""
    for i, a in enumerate(contexts):
        for j in range(i):
            b, p, q = contexts[j], ahead[i], ahead[j]
            if _shared(a[p:], b[q:], False) + _shared(a[:p], b[:q], True) >= length:
                return True
    return False


def _scan(length: int, merged: bool):
    """Spans of every part (part, members): of each maximal repeat, or merged by member."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, members in zip(batch.column("part").to_pylist(), batch.column("members").to_pylist(), strict=True):
                if len(members) <= FEW and members[0]["ahead"] >= 0 and not may_repeat([x["context"] for x in members], [x["ahead"] for x in members], length):
                    continue
                about = [(x["k1"], x["k2"], x["t1"], x["t2"], x["bytes"], x["lo"]) for x in members]
                covered: list[list[tuple[int, int]]] = [[] for _ in members]
                for k, (shared, found) in enumerate(maximal_repeats([x["context"] for x in members], [x["more"] + 1 for x in members], length)):
                    for i, p in found:
                        if merged:
                            covered[i].append((p, p + shared))
                        else:
                            out.append((name, k, *about[i], p, p + shared))
                for x, spans in zip(about, covered, strict=True):
                    out += [(name, -1, *x, a, b) for a, b in merge_runs(spans)]
            columns = list(zip(*out, strict=True)) if out else [()] * 10
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "repeat", "k1", "k2", "t1", "t2", "bytes", "lo", "start", "end"])

    return scan


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _classes(length: int, step: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, c1, c2, t1, t2, size, lo, more, ahead, context in zip(*(batch.column(c).to_pylist() for c in ("h", "c1", "c2", "t1", "t2", "bytes", "lo", "more", "ahead", "context")), strict=True):
                p = 0
                while p <= more:
                    # places before the anchor fall by one with each start; a class ends where they leave its range
                    q = (ahead - p) // step
                    last = min(more, ahead - q * step)
                    # the bytes of every window of the full class, whatever part of it this run has
                    core = context[max(0, ahead - q * step) : ahead - q * step - step + 1 + length]
                    whole = _digest(b"%d/%d/" % (ahead - p, last - p) + context[p : last + length])
                    rows.append((_digest(b"%d/%d/" % (h, q) + core[: length - step + 1]), *np.frombuffer(whole, np.int64).tolist(), h, c1, c2, p, t1, t2, size, lo + p, last - p, context[p : last + length]))
                    p = last + 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 13
            kinds = [pa.binary(), *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["core", "k1", "k2", "h", "c1", "c2", "ahead", "t1", "t2", "bytes", "lo", "more", "context"])

    return cut


_CLASS = f"core binary, k1 long, k2 long, h long, c1 long, c2 long, ahead int, {_TEXT}, lo int, more int, context binary"


def _windows(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = batch.column("more").to_numpy()
            at = np.repeat(np.arange(len(batch)), more + 1)
            p = np.arange(len(at)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
            held = batch.column("context").to_pylist()
            digests = [_digest(held[i][k : k + length]) for i, k in zip(at.tolist(), p.tolist(), strict=True)]
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *(rows.column(c) for c in ("k1", "k2", "t1", "t2", "bytes", "lo")), pa.array(p.astype(np.int32))], ["window", "k1", "k2", "t1", "t2", "bytes", "lo", "start"])

    return cut


def _members(rows: DataFrame, by: str, name: str) -> DataFrame:
    return rows.groupBy(by).agg(F.collect_list(F.struct(*_PART)).alias("members")).select(F.hex(by).alias("part") if name == "hex" else F.col(by).cast("string").alias("part"), "members")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART, merged: bool = False) -> DataFrame:
    """(repeat, t1, t2, bytes, start, end): every occurrence of every maximal repeat, by text.

    Texts are named by two hashes and their length; equal texts are one. Repeats
    longer than an anchor's context come as overlapping pieces of it. With
    ``merged`` the occurrences in one context come as the spans they cover, and
    ``repeat`` is null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), F.octet_length(text).alias("bytes"), text.alias("text")).filter(F.col("bytes") >= length)
    # read twice rather than kept: the anchors of all texts are larger than the texts are on disk
    shared = named.select("text").mapInArrow(_anchor_hashes(length, gram), "h long").groupBy("h").count().filter("count > 1").select("h")
    found = named.mapInArrow(_anchors(length, gram), _RUN)
    place = ["t1", "t2", "bytes", "lo", "more", "ahead"]
    # nothing but the join reads what an anchor is dealt to, so AQE can split a hot one
    runs_ = keep(found.join(shared, "h", "left_semi").select("h", "c1", "c2", *place))
    context = keep(runs_.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("at")))
    several = context.groupBy("h").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    wanted = context.join(several, "h").select("h", "c1", "c2", "at.*").groupBy("t1", "t2", "bytes").agg(F.collect_list(F.struct(*_WANTED)).alias("wanted"))
    once = named.groupBy("t1", "t2", "bytes").agg(F.first("text").alias("text"))
    kinds = f"h long, c1 long, c2 long, lo int, more int, ahead int, {_TEXT}, context binary"
    cut = keep(once.join(wanted, ["t1", "t2", "bytes"]).mapInArrow(_contexts(length), kinds))
    parts = cut.join(several, "h").withColumns({"k1": F.col("c1"), "k2": F.col("c2")})
    scanned = _members(parts.filter(F.col("contexts") <= part), "h", "long").mapInArrow(_scan(length, merged), _SPAN)
    span = lambda lo: (F.col("t1"), F.col("t2"), F.col("bytes"), (lo + F.col("start")).alias("start"), (lo + F.col("end")).alias("end"))
    group = F.lit(None).cast("string") if merged else F.concat_ws("/", "part", "repeat")
    whole = runs_.join(context.filter("n > 1").select("h", "c1", "c2"), ["h", "c1", "c2"], "left_semi").select(
        (F.lit(None).cast("string") if merged else F.concat_ws("/", "h", "c1", "c2")).alias("repeat"), "t1", "t2", "bytes", F.col("lo").alias("start"), (F.col("lo") + F.col("more") + length).alias("end")
    )
    # a context that occurs more than once is repeated as a whole, so what is in it is only listed where groups are asked for
    own = scanned.select(group.alias("repeat"), "k1", "k2", "t1", "t2", "bytes", "lo", "start", "end")
    if not merged:
        own = own.drop("t1", "t2", "bytes", "lo").join(runs_.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "t1", "t2", "bytes", "lo"), ["k1", "k2"])
    spans = whole.union(own.select("repeat", *span(F.col("lo"))))
    # few corpora have a part so large; its classes are only planned where one is
    if not several.filter(F.col("contexts") > part).isEmpty():
        spans = spans.union(_large_parts(parts.filter(F.col("contexts") > part), runs_, length, part, merged))
    # texts that are repeated have the same places
    return spans.distinct()


def _large_parts(parts: DataFrame, runs_: DataFrame, length: int, part: int, merged: bool) -> DataFrame:
    """Spans of parts of very many contexts, class by class."""
    classes = parts.select("h", "c1", "c2", "t1", "t2", "bytes", "lo", "more", "ahead", "context").mapInArrow(_classes(length, STEP), _CLASS)
    classes = keep(classes)
    shared = classes.groupBy("core").count().filter("count > 1").select("core")
    live = classes.join(shared, "core", "left_semi")
    kinds = keep(live.groupBy("core", "k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "bytes", "lo", "more", "context")).alias("x")).select("core", "k1", "k2", "n", "x.*"))
    sizes = kinds.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    # pieces of classes do not tell where their anchor is
    held = kinds.join(sizes, "core").withColumn("ahead", F.lit(-1))
    scanned = _members(held.filter(F.col("kinds") <= part), "core", "hex").mapInArrow(_scan(length, merged), _SPAN)
    windows = held.filter(F.col("kinds") > part).select("k1", "k2", "t1", "t2", "bytes", "lo", "more", "context").mapInArrow(_windows(length), f"window binary, k1 long, k2 long, {_TEXT}, lo int, start int")
    often = windows.groupBy("window").count().filter("count > 1").select("window")
    windows = windows.join(often, "window", "left_semi").select(F.hex("window").alias("repeat"), "k1", "k2", "t1", "t2", "bytes", "lo", "start", (F.col("start") + length).alias("end"))
    own = scanned.select(F.concat_ws("/", "part", "repeat").alias("repeat"), "k1", "k2", "t1", "t2", "bytes", "lo", "start", "end").union(windows)
    equal = live.join(kinds.filter("n > 1").select("core", "k1", "k2"), ["core", "k1", "k2"], "left_semi").select(
        F.concat_ws("/", F.hex("core"), "k1", "k2").alias("repeat"), "k1", "k2", "t1", "t2", "bytes", "lo", F.lit(0).alias("start"), (F.col("more") + length).alias("end")
    )
    if merged:
        both = own.union(equal)
        return both.select(F.lit(None).cast("string").alias("repeat"), "t1", "t2", "bytes", (F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("end")).alias("end"))
    # every occurrence of a class's content, in every occurrence of its context
    places = classes.select("k1", "k2", "h", "c1", "c2", "ahead").join(runs_.select("h", "c1", "c2", "t1", "t2", "bytes", "lo"), ["h", "c1", "c2"]).select("k1", "k2", "t1", "t2", "bytes", (F.col("lo") + F.col("ahead")).alias("lo"))
    both = own.union(equal).select("repeat", "k1", "k2", "start", "end").distinct().join(places, ["k1", "k2"])
    return both.select("repeat", "t1", "t2", "bytes", (F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("end")).alias("end"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            gone = merge_runs([(s["start"], s["end"]) for s in spans or []])
            keep, at = hashlib.sha256(), 0
            for a, b in gone:
                keep.update(raw[at:a])
                at = b
            keep.update(raw[at:])
            rows.append((len(raw), sum(b - a for a, b in gone), len(gone), keep.hexdigest(), [{"start": a, "end": b} for a, b in gone]))
        n, removed, count, digest, kept = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(digest, pa.string()), pa.array(kept, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans for every row of ``docs`` (doc_id, text, ...).

    spans are the maximal runs of bytes covered by a string of ``length`` bytes that
    also starts anywhere else, the same text included and overlaps counted. Null
    and empty texts have no bytes. Repeated rows count as further documents; other
    columns are ignored; an empty table gives an empty result.
    """
    found = repeats(docs, length, gram, part, merged=True).select("t1", "t2", "bytes", "start", "end")
    spans = found.groupBy("t1", "t2", "bytes").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), F.octet_length(text).alias("bytes"), text.alias("text"))
    return rows.join(spans, ["t1", "t2", "bytes"], "left").select("doc_id", "text", "spans").mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    )
