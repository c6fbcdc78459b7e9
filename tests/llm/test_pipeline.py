"""The whole pipeline, each stage's rows against a version written out over what the stage before has kept."""

import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
import corpus_pipeline  # noqa: E402

from tideframe.llm import mixing, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"
ALNUM, NOT_SPACE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, those of the documents first."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return out


def key(r):
    return (r["doc_id"], r["text"])


def test_toxic_documents_go(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    high = {r["doc_id"] for r in toxicity.score_documents(docs, model).collect() if r["score"] >= 0.7}
    assert high and Counter(map(key, stages[1])) == Counter(key(r) for r in stages[0] if r["doc_id"] not in high)


def test_one_of_each_group_stays(stages):
    before, after = {key(r) for r in stages[1]}, {key(r) for r in stages[2]}
    sets = {}
    for k in before:
        w = NOT_SPACE.findall(lowered(k[1]))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    by = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            by[g].append(k)
    up = {k: k for k in before}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, s in sets.items():
        for other, shared in Counter(x for g in s for x in by[g] if x != k).items():
            if 100 * shared >= 80 * (len(s) + len(sets[other]) - shared):
                up[top(k)] = top(other)
    groups = defaultdict(set)
    for k in before:
        groups[top(k)].add(k)
    assert len(stages[2]) == len(after) == len(groups) < len(before) and all(len(g & after) == 1 for g in groups.values())


def test_benchmark_passages_go(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ALNUM.findall(lowered(r["text"]))
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = ALNUM.findall(lowered(text))
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    clean = {key(r) for r in stages[2] if not hit(r["text"])}
    assert {key(r) for r in stages[3]} == clean and len(clean) < len(stages[2])


def test_draw(spark, stages):
    rows = spark.createDataFrame(stages[3], spark.read.parquet(f"{SF}/documents.parquet").schema)
    sampled = {r["doc_id"] for r in mixing.mix(rows).collect() if r["sampled"]}
    assert {r["doc_id"] for r in stages[4]} == sampled and 0 < len(stages[4]) < len(stages[3])
    assert {key(r) for r in stages[4]} <= {key(r) for r in stages[3]}


def test_shards(stages):
    last = stages[5]
    assert Counter(map(key, last)) == Counter(map(key, stages[4]))
    sizes = Counter(r["shard"] for r in last)
    assert set(sizes) <= set(range(40)) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in last if r["shard"] == shard) == list(range(n))
    assert all(r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) and r["size"] == len((r["text"] or "").encode()) + 16 for r in last)
    assert all((r["lang"], r["source"]) == next((x["lang"], x["source"]) for x in stages[0] if key(x) == key(r)) for r in last)


def test_awkward_columns(spark):
    """Nulls everywhere, repeated rows, and names that stages use themselves; what is kept keeps its columns."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "_order", "_part", "__tokens", "node", "row", "shard", "size", "a.b"]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, ["long", "string", "string", "string", "long", "int", "string", "int", "string", "string", "string", "string", "int"], strict=True))
    rows = [(i, f"some plain words number {i} and {i * 7} of document {i * 13}", "en", "a", 5, i, "p", 1, "n", "r", "mine", "s", i) for i in range(60)]
    rows += [(1, rows[1][1], "en", "a", 5, 1, "p", 1, "n", "r", "mine", "s", 1)] * 3 + [(None,) * 13, (None, "words without an id", None, None, None, 7, None, None, None, None, None, None, None), (99, "", "de", None, 0, 8, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema) if stage is not corpus_pipeline.STAGES[-1][1] else stage(spark, docs, SF)
    out = docs.collect()
    assert out and all(r["_order"] == r["doc_id"] for r in out if r["doc_id"] is not None and r["doc_id"] < 60) and {type(r["shard"]) for r in out} == {int}
    assert all(r["a.b"] == r["doc_id"] for r in out if r["doc_id"] is not None and r["doc_id"] < 60)
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
