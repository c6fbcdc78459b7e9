"""Corpus operators against versions written out in plain Python, on small tables."""

import math
import random
import re
import sys
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tideframe.llm import decontaminate, language, licenses, minhash, mixing, sharding, toxicity, wordhash  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


class TestHashes:
    def test_structured_words_do_not_collide(self):
        found = [thue_morse(1024), thue_morse(1024).translate({97: 98, 98: 97}), thue_morse(4096)[1024:2048], "a" * 300, "a" * 301, "ab" * 100, "ba" * 100]
        data = np.frombuffer("".join(found).encode(), np.uint8)
        ends = np.cumsum([len(x) for x in found])
        assert len(set(wordhash.hash_spans(data, ends - [len(x) for x in found], ends).tolist())) == len(set(found))

    def test_operators_tell_them_apart(self, spark):
        one, other = thue_morse(1024), thue_morse(1024).translate({97: 98, 98: 97})
        df = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
        bench = spark.createDataFrame([(1, one)], "item_id long, text string")
        assert {r["doc_id"]: r["contaminated"] for r in decontaminate.benchmark_hits(df, bench).collect()} == {1: True, 2: False}
        assert {r["component_id"] for r in minhash.near_duplicates(df).collect()} == {1, 2}


class TestLanguage:
    def brute(self, rows):
        """Log frequencies with a floor of one half, backing off to n-grams, from the rules alone."""
        cut = lambda t: re.findall("[" + "".join(map(re.escape, {c for c in t if unicodedata.category(c)[0] == "L"})) + "]+", t) if any(unicodedata.category(c)[0] == "L" for c in t) else []
        train = [(x, cut((t or "").lower())) for i, t, x in rows if x is not None and t is not None and zlib.crc32(str(i).encode()) % 3 != 1]
        langs = sorted({x for x, w in train if w})
        counts = {0: Counter(), 1: Counter(), 2: Counter(), 3: Counter(), 4: Counter()}
        pieces = lambda w, n: [f"^{w}$"[k : k + n] for k in range(len(w) + 3 - n)]
        for x, own in train:
            for w in own:
                counts[0][x, w] += 1
                for n in (1, 2, 3, 4):
                    for g in pieces(w, n):
                        counts[n][x, g] += 1
        total = {n: Counter() for n in counts}
        keys = {n: {k for _, k in c} for n, c in counts.items()}
        for n, c in counts.items():
            for (x, _), m in c.items():
                total[n][x] += m
        log = lambda n, x, k: math.log((counts[n][x, k] + 0.5) / (total[n][x] + 0.5 * (len(keys[n]) + 1)))

        def word(w, x):
            if w in keys[0]:
                return log(0, x, w)
            for n in (4, 3, 2, 1):
                known = [g for g in pieces(w, n) if g in keys[n]]
                if known:
                    return sum(log(n, x, g) for g in known) / len(known)
            return 0.0

        out = {}
        for i, t, _ in rows:
            own = cut((t or "").lower())
            if not own:
                out[i] = ("und", 0.0)
                continue
            sums = [sum(word(w, x) for w in own) for x in langs]
            best = max(range(len(langs)), key=lambda k: sums[k])
            out[i] = (langs[best], 1 / sum(math.exp((s - sums[best]) / math.sqrt(len(own))) for s in sums))
        return out

    @pytest.mark.parametrize("options", [{}, {"word_rows": 40}, {"word_rows": 0}])
    def test_scores(self, spark, docs, options):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").limit(60).collect()] + [(1000, None, "en"), (1001, "zzzzz qqqqq", None), (1002, "½ 12", "en")]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        truth = self.brute(rows)
        for r in language.identify(df, language.learn(df, **options)).collect():
            assert r["lang_pred"] == truth[r["doc_id"]][0] and abs(r["score"] - truth[r["doc_id"]][1]) < 1e-6

    def test_very_many_languages(self, spark):
        df = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} {chr(0x4E00 + i)}x", f"l{i:03d}") for i in range(300)], "doc_id long, text string, lang string")
        r = language.identify(df, language.learn(df)).filter("not held_out").collect()
        assert all(x["lang_pred"] == f"l{x['doc_id']:03d}" for x in r)


class TestMixing:
    def test_weights_are_those_of_raking(self, docs):
        r = mixing.mix(docs).collect()
        cells = Counter()
        for x in r:
            cells[x["source"], x["lang"], x["topic"]] += x["tokens"]
        total = sum(cells.values())
        aims = []
        for d, power in enumerate((0.5, 0.7, 0.0)):
            mass = Counter()
            for k, n in cells.items():
                mass[k[d]] += n
            mass = {k: n**power for k, n in mass.items() if n}
            aims.append({k: v / sum(mass.values()) * total for k, v in mass.items()})
        weight = dict.fromkeys(cells, 1.0)
        for _ in range(200):
            for d in range(3):
                now = Counter()
                for k, n in cells.items():
                    now[k[d]] += n * weight[k]
                weight = {k: w * aims[d][k[d]] / now[k[d]] if now[k[d]] else w for k, w in weight.items()}
        low, high = 0.0, 1e9
        for _ in range(300):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(1, c * w) * cells[k] for k, w in weight.items()) < total / 2 else (low, c)
        for x in r:
            w = weight[x["source"], x["lang"], x["topic"]]
            assert abs(x["weight"] - w) <= 1e-6 * max(1, w) and abs(x["probability"] - min(1, high * w)) < 1e-6

    def test_columns_named_like_ours(self, spark):
        names = ["doc_id", "text", "source", "lang", "__tokens", "__topic", "__text", "__source", "__weight", "__probability", "__sampled", "__crc", "row"]
        df = spark.createDataFrame([tuple([i, f"word{i} longer words", "s", "en", *range(9)]) for i in range(20)], ", ".join(f"`{n}` {'long' if k in (0, *range(4, 13)) else 'string'}" for k, n in enumerate(names)))
        out = mixing.draw(df, rate=1.0)
        assert out.columns == names and out.count() == 20 and mixing.mix(df).count() == 20


class TestSharding:
    def test_draws_follow_the_law(self):
        """Below a billion against numpy's own draws, beyond by mean, spread and bounds."""
        rng = np.random.default_rng(5)
        for good, bad, n in ((3_000_000_000, 5_000_000_000, 40), (1_000_000_000_000, 39_000_000_000_000, 2_000_000), (10**12, 1, 7), (10**12, 10**12, 2 * 10**12 - 3)):
            x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(600)], float)
            share = good / (good + bad)
            deviation = math.sqrt(n * share * (1 - share) * (good + bad - n) / (good + bad - 1))
            assert x.min() >= max(0, n - bad) and x.max() <= min(n, good)
            assert abs(x.mean() - n * share) <= 4.5 * max(deviation, 1e-9) / math.sqrt(600) + 1e-6
            if deviation > 1:
                assert 0.85 < x.std() / deviation < 1.15

    def test_equals_the_matrix_written_out(self, spark):
        """Every row's shard and slot from the hashes, by loops."""
        df = spark.createDataFrame([(i, f"t{i % 17}") for i in range(300)], "doc_id long, text string")
        from pyspark.sql import functions as F

        about = ["doc_id", F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 16).cast("long")]
        rows = df.select("doc_id", *(F.xxhash64(F.lit(f"3/{k}"), *about).alias(k) for k in ("block", "first", "second"))).collect()
        blocks = {}
        for r in rows:
            blocks.setdefault(r["block"] % 64, []).append(r)
        sizes = [300 // 7 + (s < 300 % 7) for s in range(7)]
        matrix = sharding.communication_matrix({b: len(v) for b, v in blocks.items()}, sizes, 3)
        shards = {s: [] for s in range(7)}
        for b, own in blocks.items():
            for rank, r in enumerate(sorted(own, key=lambda r: r["first"])):
                shards[sum(x <= rank for x in matrix[b]) - 1].append(r)
        truth = {r["doc_id"]: (s, slot) for s, own in shards.items() for slot, r in enumerate(sorted(own, key=lambda r: r["second"] % (1 << 64)))}
        assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(df, 7, seed=3).collect()} == truth


class TestLicenses:
    def scan(self, spark, *texts):
        return [r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]

    def test_scattered_words_do_not_add_up(self, spark):
        r = self.scan(spark, "Licensed under zz under the zz the apache zz apache license zz license version zz version 2", "licensed under the apache license version 2 0")
        assert r[0]["labels"] == "" and r[0]["score"] < 0.75 and r[1]["labels"] == "apache-2.0" and r[1]["score"] == 1.0

    def test_long_wording_with_words_put_in(self, spark):
        text = next(t for t, label in licenses.TEMPLATES if label == "isc").split()
        r = self.scan(spark, " ".join([*text[:9], "really", *text[9:]]), " ".join(text[:12]))
        assert "isc" in r[0]["labels"] and r[0]["score"] > 0.9 and "isc" not in r[1]["labels"]

    def test_repeated_rows_stay(self, spark):
        df = spark.createDataFrame([(1, "cc by")] * 3 + [(None, None)] * 2 + [(1, None)], "doc_id long, text string")
        r = Counter((x["doc_id"], x["n_words"], x["n_base"]) for x in licenses.scan(df).collect())
        assert r == {(1, 2, 1): 3, (None, 0, 0): 2, (1, 0, 0): 1}


class TestVersions:
    def test_versions_are_told_apart(self, spark):
        texts = ["under the gnu general public license version", "licensed under the gnu general public license version 2", "licensed under the gnu general public license version 3", "licensed under the new gnu general public license version 3 or 2"]
        found = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert found == {0: "gpl", 1: "gpl,gpl-2.0", 2: "gpl,gpl-3.0", 3: "gpl,gpl-3.0"}

    def test_telling_places(self):
        tells = licenses.telling_places([("a b", "base")], [("x a b c d e 1", "one"), ("x a b c d e 2", "two"), ("a b c d", "part"), ("q r s t", "other")])
        assert tells == [[], [[5]], [[5]], [], []]


class TestDecontaminate:
    def test_long_items_are_cut_without_loss(self, spark):
        rng = random.Random(8)
        item = [f"w{rng.randrange(50)}" for _ in range(400)]
        held = [(k, " ".join(item[a : a + n])) for k, (a, n) in enumerate([(0, 400), (13, 10), (55, 10), (60, 9), (91, 30), (388, 12), (200, 25)])]
        df, bench = spark.createDataFrame(held, "doc_id long, text string"), spark.createDataFrame([("x", " ".join(item)), ("x", " ".join(item))], "item_id string, text string")
        whole = sorted(map(str, decontaminate.benchmark_hits(df, bench).collect()))
        assert whole == sorted(map(str, decontaminate.benchmark_hits(df, bench, piece_words=30).collect()))
        assert whole == sorted(map(str, decontaminate.benchmark_hits(df, bench, piece_words=30, block_words=50).collect()))
        kept = {tuple(r) for r in decontaminate.without_benchmark(df, bench).collect()}
        assert kept == {tuple(r) for r in decontaminate.without_benchmark(df, bench, piece_words=30, block_words=50).collect()} == {held[3]}


class TestToxicity:
    def test_far_words_do_not_matter(self):
        """Marginals from neighbourhoods are those of the whole chain."""
        crf = toxicity.Crf(np.array([-3.0, 1.0, 0.8, 0.3, 0.2]), np.array([[0.5, -0.6], [-0.4, 1.5]]), -0.7)
        at, odds = np.array([3, 5, 400, 401, 405, 900]), np.array([2.0, 1.0, 3.0, 2.5, 0.5, 4.0])
        near, whole = (np.zeros(1200), np.zeros(1200))
        for s in toxicity.segments(toxicity.neighbourhoods([(1200, at, odds)], crf.reach())):
            p = crf.marginals(s)
            for i in range(len(s.length)):
                near[s.begin[i] : s.begin[i] + s.length[i]] = p[i, : s.length[i]]
        for s in toxicity.segments(toxicity.neighbourhoods([(1200, at, odds)], 2000)):
            whole = crf.marginals(s)[0, :1200]
        assert np.abs(near - whole)[at].max() < 1e-9

    def test_long_neighbourhoods_are_cut_not_dropped(self):
        found = toxicity.neighbourhoods([(1000, np.arange(0, 1000, 40), np.ones(25))])
        cut = toxicity.pieces(found, 200)
        assert len(found) == 1 and len(cut) == 5 and sum(len(x[4]) for x in cut) == 25 and all(x[2] - x[1] <= 200 for x in cut)


class TestLm:
    def test_same_whatever_the_partitions(self, docs):
        from tideframe.llm import lm

        one, other = lm.pseudo_likelihood(docs), lm.pseudo_likelihood(docs.orderBy("n_chars").repartition(7, "source"))
        found = {x["doc_id"]: x["log_prob"] for x in other.collect()}
        assert all(abs(x["log_prob"] - found[x["doc_id"]]) < 1e-6 * max(1, x["n_tokens"]) for x in one.collect())

    def test_scores_written_out(self, spark):
        """Every word's probability from the weights by loops: class, word in the class, share of its bucket."""
        import pyarrow as pa

        from tideframe.llm import lm

        rng = random.Random(4)
        held = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(100, None), (101, "W1, w1!")]
        df = spark.createDataFrame(held, "doc_id long, text string")
        counts, found = lm.word_counts(df), lm.vocabulary(df)
        net = lm.train(df, found)
        words = [re.findall("[a-z0-9]+", (t or "").lower()) for _, t in held]
        names = sorted({w for own in words for w in own})
        _, _, data, offs = next(wordhash.texts(pa.array([" ".join(names)])))
        hashes = dict(zip(names, wordhash.word_hashes(data, offs, wordhash.ALNUM)[0].tolist(), strict=True))
        rank = {h: i for i, h in enumerate(found.tolist())}
        times = Counter(w for own in words for w in own)
        bucket = Counter()
        for w, n in times.items():
            if hashes[w] not in rank:
                bucket[hashes[w] % lm.BUCKETS] += n
        number = lambda w: rank.get(hashes[w], lm.VOCABULARY - lm.BUCKETS + hashes[w] % lm.BUCKETS)
        shifts = [s for s in range(-lm.SIDE, lm.SIDE + 1) if s]

        def soft(x):
            e = [math.exp(v - max(x)) for v in x]
            return [v / sum(e) for v in e]

        r = {x["doc_id"]: x for x in lm.score(df, found, net, counts).collect()}
        for (i, _), own in zip(held, words, strict=True):
            total = 0.0
            for p, w in enumerate(own):
                h = [math.tanh(sum(float(net.embed[o][number(own[p + s]) if 0 <= p + s < len(own) else lm.VOCABULARY][d]) for o, s in enumerate(shifts))) for d in range(lm.WIDTH)]
                kind, at = divmod(number(w), lm.IN_CLASS)
                dot = lambda row, bias, h=h: sum(float(a) * b for a, b in zip(row, h, strict=True)) + float(bias)
                total += math.log(soft([dot(net.classes[c], net.class_bias[c]) for c in range(lm.CLASSES)])[kind])
                total += math.log(soft([dot(net.words[kind][k], net.word_bias[kind][k]) for k in range(lm.IN_CLASS)])[at])
                if hashes[w] not in rank:
                    total += math.log(times[w] / bucket[hashes[w] % lm.BUCKETS])
            assert r[i]["n_tokens"] == len(own) and abs(r[i]["log_prob"] - total) < 1e-3 * max(1, len(own))


class TestToxicityQuery:
    def test_scores_written_out(self, spark):
        """Every document's score from lexicon, chain and weights by loops over all of its words."""
        sf = "/root/testdata/sf0.01"
        d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
        model = toxicity.fit(d, labels)
        assert len(model.lexicon.keys) > 3
        value = dict(zip(model.lexicon.keys.tolist(), model.lexicon.values.tolist(), strict=True))
        move, emit = np.exp(model.crf.move).tolist(), model.crf.emit.tolist()
        small = d.limit(150)
        got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(small, model).collect()}
        for r in small.select("doc_id", "text").collect():
            words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate({i: i + 32 for i in range(65, 91)}))]
            data = np.frombuffer(b"".join(words), np.uint8)
            ends = np.cumsum([len(w) for w in words]).astype(int)
            starts = ends - [len(w) for w in words] if words else ends
            kinds = [wordhash.hash_spans(data, starts, ends)] + [wordhash.mix(wordhash.hash_spans(data, starts, np.minimum(ends, starts + n)) + np.uint64(n)) for n in (4, 5, 6)] if words else []
            v = [max(value.get(int(k[i]), 0.0) for k in kinds) for i in range(len(words))]
            around = lambda i: v[i] if 0 <= i < len(v) else 0.0  # noqa: B023, E731
            e = [(1.0, math.exp(min(50, max(-50, emit[0] + emit[1] * (v[i] > 0) + emit[2] * v[i] + emit[3] * around(i - 1) + emit[4] * around(i + 1))))) for i in range(len(words))]
            forward, now = [], (1.0, math.exp(model.crf.start))
            for t in range(len(words)):
                if t:
                    now = tuple(sum(now[i] * move[i][j] for i in (0, 1)) for j in (0, 1))
                now = (now[0] * e[t][0], now[1] * e[t][1])
                now = (now[0] / sum(now), now[1] / sum(now))
                forward.append(now)
            back, weighted = (1.0, 1.0), []
            for t in range(len(words) - 1, -1, -1):
                p = (forward[t][0] * back[0], forward[t][1] * back[1])
                if v[t]:
                    weighted.append(p[1] / sum(p) * v[t])
                back = tuple(sum(move[i][j] * e[t][j] * back[j] for j in (0, 1)) for i in (0, 1))
                back = (back[0] / sum(back), back[1] / sum(back))
            w = model.score
            truth = 1 / (1 + math.exp(-(w[0] + w[1] * math.log1p(sum(weighted)) + w[2] * max(weighted, default=0.0))))
            assert abs(got[r["doc_id"]] - truth) < 1e-6


class TestSuffixParts:
    def test_contexts_without_repeats_are_told(self):
        from tideframe.llm import suffixes

        rng = random.Random(6)
        for _ in range(300):
            middle = "".join(rng.choice("xyz") for _ in range(6))
            sides = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(0, 14)))  # noqa: B023, E731
            parts = [(sides(), sides()) for _ in range(3)]
            contexts, ahead = [(a + middle + b).encode() for a, b in parts], [len(a) for a, _ in parts]
            windows = [{(p - n, c[p : p + 12]) for p in range(max(0, n - 6), n + 1) if p + 12 <= len(c) and p + 12 >= n + 6} for c, n in zip(contexts, ahead, strict=True)]
            truth = any(windows[i] & windows[j] for i in range(3) for j in range(i))
            assert suffixes.may_repeat(contexts, ahead, 12) == truth


class TestShardColumns:
    """Columns of the documents come back whatever their names."""

    NAMES = ["_order", "_part", "_at", "_block", "_rank", "_begin", "_offset", "_row", "count", "a.b", "block", "a`b", "A b"]

    def test_every_name_in_use(self, spark):
        from pyspark.sql import functions as F

        from tideframe.llm import sharding

        names = [c for c in self.NAMES if "`" not in c]
        docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), *((F.col("id") * 100 + i).alias(c) for i, c in enumerate(names)))
        rows = sharding.assign(docs, shards=7, keep=names).collect()
        assert len(rows) == 300
        assert all(r[c] == r["doc_id"] * 100 + i for r in rows for i, c in enumerate(names))
        plain = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(docs, shards=7).collect()}
        assert plain == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
