"""The prefix trie against one written out as a dictionary of sequences."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tideframe.llm import tries
from tideframe.llm.queries import with_shared_heads

SCHEMA = "conv_id long, turn long, role string, text string, depth int, a long, place string, n string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def written_out(convs):
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    ends = lambda node: ",".join(str(c) for c in sorted(c for c in members[node] if len(convs[c]) == len(node)))
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends(node).encode()).hexdigest())
        for node, own in members.items()
    )


def grouped(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: x[:3])] for c, turns in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(5)


def got(df):
    assert df.columns == NAMES
    return sorted(tuple(r) for r in df.collect())


def of_convs(spark, rows, **options):
    turns = tries.ordered(frame(spark, rows))
    return got(tries.trie(turns, turns.select("conv_id").distinct(), **options))


@pytest.mark.parametrize("block", [1, 2, 3, 4, 7])
def test_blocks_of_any_length(spark, block):
    rng = random.Random(block)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "y", "zé"]) if rng.random() < 0.7 else "x") for c in range(-20, 60) for t in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 12]))]
    rows += [(100 + c, t, "u", f"same {t}") for c in range(30) for t in range(8)] + [(200 + c, t, "u", f"same {t}") for c in range(3) for t in range(4 + c)]
    assert of_convs(spark, rows, block=block) == written_out(grouped(rows))


def test_spans_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(tries, "SPAN", 3)
    monkeypatch.setattr(tries, "LISTED", 4)
    rng = random.Random(7)
    rows = [(c, t, "u", f"turn {t if t < cut else (c, t)}") for c, cut in ((1, 90), (2, 60), (3, 33), (4, 90), (50, 17)) for t in range(rng.choice([80, 90]))]
    rows += [(1000 + c, 0, "u", "hello") for c in range(40)]
    assert of_convs(spark, rows) == written_out(grouped(rows))


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "u", ""), (1, 0, "a", None), (2, 0, None, ""), (None, 0, "u", "x"), (None, None, None, None), (3, 5, "u", "a\x00b"), (4, 5, "ua", "\x00b"), (5, -1, "", ":u"), (6, 1, "u" * 3, "x" * 100_000)]
    rows += [(7, 1, "u", "again")] * 900 + [(8, 1, "u", "again")] * 2
    assert of_convs(spark, rows) == written_out(grouped(rows))
    assert of_convs(spark, []) == []
    assert of_convs(spark, [(None, 1, "u", "x")]) == []
    turns = tries.ordered(frame(spark, [(9, 0, "u", "x")])).filter("place > 0")
    assert got(tries.trie(turns, frame(spark, [(9, 0, "u", "x"), (8, 0, "u", "x")]).select("conv_id"))) == written_out({9: [], 8: []})


def test_shared_heads(spark):
    rng = random.Random(5)
    ids = [*range(-12, 70), 10**12, 10**12 + 3, 1234567, 1234565]
    rows = [(c, t, "u", f"{c} {t}") for c in ids if c not in (20, 35) for t in range(rng.choice([1, 3, 8, 11]))]
    own = grouped(rows)
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    turns = tries.ordered(frame(spark, rows))
    assert got(tries.trie(with_shared_heads(turns), turns.select("conv_id").distinct())) == written_out(rebuilt)
