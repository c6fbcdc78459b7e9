"""Best-two-fit packing against a version that packs one bin at a time, and against the tokenizer itself."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideframe.llm import packing
from tideframe.llm.queries import QUERIES

SF, FILE = "/root/testdata/sf0.001", path("word_bpe_49k.json")
ODD = ["", " a", "a ", "\n\n", "é ́x İstanbul <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> it's WE'LL\x85a\x1cb \x00 x y 12345 ½ ?!..", "ΣίΣ J̌ x​y ﻿ 　z", "'s 't 'll'd x's", "".join(map(chr, range(1, 3000))), " ".join(map(chr, range(1, 3000)))]


def one_by_one(lengths, limit):
    """The bins of best-two-fit, as sorted tuples, from a list of lengths."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, rest, gap = [], [], limit
        for x in left:
            if x <= gap:
                own.append(x)
                gap -= x
            else:
                rest.append(x)
        while gap:
            least, best = min(own), None
            for i, x in enumerate(rest):
                for y in rest[i + 1 :]:
                    if least < x + y <= gap + least and (best is None or (x + y, x) > (sum(best), best[0])):
                        best = (x, y)
            if best is None:
                break
            own.remove(least)
            own += best
            rest.append(least)
            for x in best:
                rest.remove(x)
            gap += least - sum(best)
        bins.append(tuple(sorted(own)))
        left = sorted(rest, reverse=True)
    return bins


def planned(lengths, limit):
    """The bins that the plan gives, from its runs, each rank once."""
    counts = Counter(lengths)
    runs, sequences = packing.plan(counts, limit)
    bins = {}
    ends = {tuple(r[:2]): None for r in runs}
    for i, (x, first, each, sequence, _) in enumerate(runs):
        last = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == x else counts[x]
        for rank in range(first, last):
            bins.setdefault(sequence + (rank - first) // each, []).append(x)
    assert len(ends) == len(runs) and len(bins) == sequences
    return [tuple(sorted(b)) for b in bins.values()]


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_that_of_single_bins(seed):
    rng = random.Random(seed)
    limit = rng.choice([12, 40, 100])
    lengths = [rng.randint(1, rng.choice([limit, limit // 2, 7])) for _ in range(rng.randint(1, 160))]
    assert Counter(planned(lengths, limit)) == Counter(one_by_one(lengths, limit))


def test_two_replace_the_smallest():
    def filled(lengths, limit):
        counts = Counter(lengths)
        return packing.fill(sorted(counts), np.array([counts[x] for x in range(limit + 1)]), limit)

    assert filled([9, 6, 4, 4], 17) == {9: 1, 4: 2}  # 9 + 6 leaves 2, 9 + 4 + 4 nothing
    assert filled([9, 6, 4, 3], 17) == {9: 1, 4: 1, 3: 1}
    assert filled([9, 6, 3, 3], 17) == {9: 1, 6: 1}  # two that fill no more than the one stay out
    assert filled([9, 6, 4], 17) == {9: 1, 6: 1}  # there is one of 4 only


def test_close_to_the_least():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 50_000).astype(int) + 1)
    runs, sequences = packing.plan(Counter(lengths.tolist()))
    assert sequences <= -(-int(lengths.sum()) // 4096) + 1
    many = packing.plan({x: n * 10**9 for x, n in Counter(lengths.tolist()).items()})
    assert len(many[0]) < 3 * len(runs) and many[1] <= 1.00001 * int(lengths.sum()) * 10**9 / 4096


def test_words_give_the_ids_of_whole_texts():
    whole = Tokenizer.from_file(FILE)
    words = packing.Words(open(FILE).read(), most=50)
    for texts in (ODD, ODD[::-1], ["x" * 5000, "a b c"] + ODD):
        ids, first = words.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def held(rows, limit=4096):
    """Offsets leave no gap, sequences are not too long."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert 0 < end <= limit
    return len(by)


def test_query(spark):
    rows = QUERIES["op12_best_two_fit"](spark, SF).collect()
    whole = Tokenizer.from_file(FILE)
    want = Counter()
    total = 0
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert held(rows) <= -(-total // 4096) + 1


def test_awkward_rows(spark):
    schema = "doc_id long, text string, piece string, length string, sequence_id long, __rank int"
    rows = [(1, "One two.", "x", "y", 5, 0)] * 3000 + [(None, None, None, None, None, None)] * 2 + [(2, "", "", "", 0, 0), (3, "word " * 9000, "", "", 1, 1)] + [(10 + i, t, "", "", 1, 1) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, schema)
    out = packing.pack(docs, FILE, limit=64)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = out.collect()
    held(got, 64)
    own = Counter(r["doc_id"] for r in got)
    assert own[1] == 3000 and own[None] == 2 and own[2] == 1 and own[3] == -(-9001 // 64)
    assert {(r["length"], r["ids_crc32"]) for r in got if r["doc_id"] in (None, 2)} == {(1, zlib.crc32(np.array([1], "<u4").tobytes()))}
    assert packing.pack(docs.filter("doc_id = -1"), FILE).collect() == []


def test_sequences_hold_the_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = Tokenizer.from_file(FILE)
    want = {r["doc_id"]: [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    found = {}
    for r in packing.sequences(docs, FILE, limit=512).collect():
        assert len(r["ids"]) <= 512
        for doc, at, end in zip(r["doc_ids"], r["starts"], [*r["starts"][1:], len(r["ids"])], strict=True):
            found.setdefault(doc, []).append(r["ids"][at:end])
    assert {d: sum(map(len, p)) for d, p in found.items()} == {d: len(ids) for d, ids in want.items()}
    assert all(Counter(map(tuple, p)) == Counter(tuple(want[d][i : i + 512]) for i in range(0, len(want[d]), 512)) for d, p in found.items())


def test_too_long_is_refused(spark):
    rows = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("ids_crc32"), F.lit(9).cast("long").alias("length"))
    with pytest.raises(ValueError):
        packing.place(rows, limit=8)
