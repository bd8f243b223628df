"""Lexical search, language-model scores and phrase mining against plain versions."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginwatch.llm import collocations, interpolation, lexical_search, quality, token_shards

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, rank int, score double, item string, part int, shard long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COMMON = "the quick brown fox, the quick brown dog; Ünïcode Wörd the\tquick brown fox\nthe end"


@pytest.fixture(scope="module")
def docs(spark):
    """The small corpus with null ids and texts, empty and very long texts, repeated rows, a passage in a
    third of all rows, and extra columns whose names the operators use inside."""
    extra = [
        (None, "a null id, the quick brown fox", "en"),
        (9001, None, "en"),
        (9002, "", None),
        (9003, "no language, the quick brown fox", None),
        (9003, "no language, the quick brown fox", None),
        (9004, "word " * 60_000, "en"),
        (9005, "...!!! \t\n", "fr"),
        *[(9100 + k, f"{COMMON} tail{k}", "en") for k in range(100)],
    ]
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rows = rows.union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    own = {"rank": F.lit(1), "score": F.lit(0.5), "item": F.lit("x"), "part": F.lit(3), "shard": F.lit(7).cast("long")}
    return rows.withColumns(own).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def texts(docs):
    return [(r.doc_id, (r.text or "").translate(LOWER), r.lang) for r in docs.select("doc_id", "text", "lang").collect()]


# quality


def test_quality_weights_do_not_follow_the_layout_of_the_input(spark):
    rows, labels = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "labels"))
    a, b = (quality.train(rows.repartition(n), labels.repartition(n), rounds=2) for n in (3, 7))
    assert a.b == b.b and (a.w == b.w).all() and (a.v == b.v).all()


def test_mean_of_weights_by_rows():
    import pyarrow as pa

    sums = [(np.array([2.0, 4.0]) * 3).tobytes(), np.array([6.0, 0.0]).tobytes()]
    got = quality._mean_of_block(pa.table({"block": [5, 5], "slice": [1, 0], "n": [3, 1], "sums": sums}))
    assert np.frombuffer(got["mean"][0].as_py()).tolist() == [3.0, 3.0]


# arrays


def test_packing_round_trips():
    values = np.array([0, 1, 127, 128, 300, 1 << 20, (1 << 62) + 5])
    assert token_shards.unpack(token_shards.pack(values)[0]).tolist() == values.tolist()
    columns = token_shards.unpacked_all(token_shards.packed(values, np.zeros(0, np.int64), values[:3]))
    assert [c.tolist() for c in columns] == [values.tolist(), [], [0, 1, 127]]


def test_pairs_beyond_one_word():
    a, b = np.array([1 << 40, 5, 1 << 40, 5]), np.array([1 << 40, 7, 1 << 40, 8])
    at, rank = token_shards.pairs(a, b)
    assert rank.tolist() == [2, 0, 2, 1]
    assert list(zip(a[at], b[at])) == [(5, 7), (5, 8), (1 << 40, 1 << 40)]


def test_union_of_tries_sums_equal_paths():
    def trie(*grams):
        a, b, c = np.array(grams).T
        one = np.ones((1, len(a)), np.int64)
        return token_shards.Grams.counted(a, b, np.arange(len(a)), c, one, one)[0]

    first, second = trie((1, 2, 3), (1, 2, 4), (2, 2, 2)), trie((1, 2, 3), (9, 1, 1))
    again = token_shards.Grams.of_bytes(first.to_bytes())
    whole, states = token_shards.Grams.united([again, second])
    assert list(zip(whole.a, whole.b, whole.w2[0])) == [(1, 2, 3), (2, 2, 1), (9, 1, 1)]
    assert list(zip(whole.parents(), whole.c, whole.w3[0])) == [(0, 3, 2), (0, 4, 1), (1, 2, 1), (2, 1, 1)]
    assert states[1][0].tolist() == [0, 2]
    assert whole.weights(np.array([9, 9, 1]), np.array([1, 2, 2])).tolist() == [1, 0, 3]


def test_shards_are_bounded_and_whole(docs):
    def each(number, batch):
        sizes = [len(x) for x in batch.column(0).to_pylist()]
        yield {"shard": [number], "rows": [len(sizes)], "size": [sum(sizes)]}

    found = token_shards.map_shards(docs.select("text"), "shard long, rows int, size long", each, 50_000).collect()
    assert len({r["shard"] for r in found}) == len(found) > 5
    assert sum(r["rows"] for r in found) == docs.count()
    assert all(r["size"] <= 50_000 or r["rows"] == 1 for r in found)


# ranked search


def plain_search(corpus, items, top=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    counted = [(d, Counter(find(text))) for d, text, _ in corpus]
    sizes = [sum(c.values()) for _, c in counted]
    n, total = sum(1 for s in sizes if s), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(find((text or "").translate(LOWER))), []
        for (d, c), size in zip(counted, sizes):
            m = 100 - 75 + (75 * size * n) // total
            score = sum(
                k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, k in asked.items()
                if t in c
            )
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(found[:top])]
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("shard_bytes, item_terms", [(1 << 25, 200_000), (20_000, 300)])
def test_search_equals_plain_scoring(spark, docs, shard_bytes, item_terms):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items += [(7001, None), (7002, ""), (7003, "QUICK quick fox"), (7004, "nowhere-to-be-found"), (None, "tail7 wörd")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    index = lexical_search.build_index(docs, shard_bytes)
    found = lexical_search.digests(lexical_search.search(index, table, item_terms=item_terms)).collect()
    assert sorted(map(tuple, found), key=key) == sorted(plain_search(texts(docs), items), key=key)


def test_search_of_repeated_items_and_nothing(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "quick fox"), (1, "quick fox")], "item_id long, text string")
    found = lexical_search.search(lexical_search.build_index(docs), items)
    assert found.groupBy("item").count().select("count").collect() == [(10,), (10,)]
    assert lexical_search.search(lexical_search.build_index(no_docs), items).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs), items.limit(0)).count() == 0


def test_non_essential_blocks_stay_packed():
    """A common light term does not get its blocks unpacked where its bound cannot lift a document."""
    n = 4000
    sizes = np.full(n, 10)

    def listed(docs, tf):
        docs = np.array(docs)
        gaps = np.diff(docs, prepend=-1)
        body, ends = token_shards.pack(np.stack([gaps, tf], 1).ravel())
        blocks = np.arange(0, len(docs), lexical_search.BLOCK)
        lasts = np.append(blocks[1:], len(docs)) - 1
        heads = [docs[lasts], np.maximum.reduceat(tf, blocks), np.full(len(blocks), 10), ends[2 * lasts + 1]]
        return lexical_search._List(np.stack(heads, 1).astype("<i4").tobytes(), body.tobytes(), lambda f, s: 1000 * f // (f + s), sizes)

    rare = listed(range(0, 40, 4), np.full(10, 3))
    common = listed(range(n), np.ones(n, np.int64))
    found, scores = lexical_search._best([(1000, rare), (1, common)], n, 10)
    assert found.tolist() == list(range(0, 40, 4))
    assert len(common.opened) < len(common.last) / 4


# language model


def test_scores_equal_plain_interpolation(docs, monkeypatch):
    monkeypatch.setattr(token_shards, "PART_ENTRIES", 20_000)
    learnt = {}
    fit = interpolation.fit_weights

    def spy(*args):
        learnt["weights"] = fit(*args)
        return learnt["weights"]

    monkeypatch.setattr(interpolation, "fit_weights", spy)
    found = interpolation.lm_scores(docs, rounds=4, shard_bytes=100_000).collect()
    l1, l2, l3 = learnt["weights"]

    tokens = [(d, re.findall(r"[^\x20\x09-\x0D]+", text) + [" "]) for d, text, _ in texts(docs)]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in tokens}
    one, two, three = Counter(), Counter(), Counter()
    for d, words in tokens:
        if not held[d]:
            before = [" ", *words]
            one.update(words)
            two.update(zip(before, words))
            three.update(zip(before, words, words[1:]))
    n, v = sum(one.values()), len(one)
    expected = []
    for d, words in tokens:
        before, base, score = [" ", *words], 0.0, 0.0
        for i, w in enumerate(words):
            base += math.log10((one[w] + 1) / (n + v + 1))
            p = l1 * one[w] / n + (1 - l1) / (v + 1)
            if c := one[before[i]]:
                weight = l2[c.bit_length() - 1]
                p = weight * two[before[i], w] / c + (1 - weight) * p
            if i and (c := two[before[i - 1], before[i]]):
                weight = l3[c.bit_length() - 1]
                p = weight * three[before[i - 1], before[i], w] / c + (1 - weight) * p
            score += math.log10(p)
        known = sum(one[w] > 0 for w in words)
        expected.append((d, held[d], len(words), known, n, round(base, 5), round(score, 5)))
    got = [(*r[:5], round(r.base_score, 5), round(r.score, 5)) for r in found]
    assert sorted(got, key=key) == sorted(expected, key=key)
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_weights_equal_plain_expectation_maximisation(spark):
    rows = [(3, 4, 2, 2, 1, 5), (1, 9, 0, 0, 0, 2), (0, 0, 0, 0, 0, 3), (7, 5, 5, 3, 0, 1)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in (*interpolation.COUNTS, "n")))
    l1, l2, l3 = interpolation.fit_weights(table, 20, 6, rounds=3)
    w = {(1, 0): 0.5}
    for _ in range(3):
        own, every = defaultdict(float), defaultdict(float)
        for one, context2, two, context3, three, n in rows:
            f1, p1 = w[1, 0] * one / 20, 0.0
            p1 = f1 + (1 - w[1, 0]) / 7
            b2, b3 = (2, context2.bit_length() - 1), (3, context3.bit_length() - 1)
            w2, w3 = (w.get(b2, 0.5) if context2 else 0.0), (w.get(b3, 0.5) if context3 else 0.0)
            f2, f3 = (w2 * two / context2 if context2 else 0.0), (w3 * three / context3 if context3 else 0.0)
            p2 = f2 + (1 - w2) * p1
            p3 = f3 + (1 - w3) * p2
            left = n
            for on, b, f, p in ((context3, b3, f3, p3), (context2, b2, f2, p2), (1, (1, 0), f1, p1)):
                if on:
                    own[b] += left * f / p
                    every[b] += left
                left -= left * f / p
        w = {b: (own[b] + 1) / (every[b] + 2) for b in every}
    assert l1 == pytest.approx(w[1, 0])
    assert {(2, b): l2[b] for b in (2, 3)} == pytest.approx({b: x for b, x in w.items() if b[0] == 2})
    assert l3[1] == pytest.approx(w[3, 1]) and l3[0] == 0.5


def test_probabilities_sum_to_one():
    """Over all words of the vocabulary and one unknown word, for every context."""
    one, two, three = np.array([5, 3, 2, 0]), np.array([2, 1, 0, 0]), np.array([1, 0, 0, 0])
    weights = (0.7, np.linspace(0.1, 0.9, 48), np.linspace(0.2, 0.8, 48))
    for context2, context3 in ((3, 1), (3, 0), (0, 0)):
        counts = (one, np.full(4, context2), two * (context2 > 0), np.full(4, context3), three * (context3 > 0))
        assert interpolation._probability(counts, 10, 3, *weights).sum() == pytest.approx(1)


def test_scores_of_an_empty_table_and_of_held_out_rows_alone(spark, no_docs):
    assert interpolation.lm_scores(no_docs, rounds=1).count() == 0
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = spark.createDataFrame([(k, "only held out") for k in held], "doc_id long, text string")
    found = interpolation.lm_scores(rows, rounds=1).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found} == {(4, 0, 0, 0.0, 0.0)}


# phrases


def plain_phrases(corpus, least, top, inside_pct=50):
    seen, total = defaultdict(Counter), Counter()
    for _, text, lang in corpus:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                seen[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in seen.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= inside_pct * f[q]}
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        rows.sort()
        out += [
            (lang, i + 1, p.decode(), -a, left, right, total[lang], -score)
            for i, (score, a, p, left, right) in enumerate(rows[:top])
        ]
    return out


@pytest.mark.parametrize("least, top, shard_bytes", [(10, 2000, 1 << 24), (2, 25, 30_000)])
def test_phrases_equal_plain_counting(docs, monkeypatch, least, top, shard_bytes):
    monkeypatch.setattr(token_shards, "PART_ENTRIES", 20_000)
    found = collocations.collocations(docs, least, top, shard_bytes=shard_bytes)
    assert sorted(map(tuple, found.collect())) == sorted(plain_phrases(texts(docs), least, top))


def test_scores_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("5000000000000 AS a", "6000000000000 AS l", "7000000000000 AS r")
    expected = 10**6 * 5000000000000**2 // (6000000000000 * 7000000000000)
    assert row.select(collocations._score("a", "l", "r")).first()[0] == expected


def test_phrases_of_an_empty_table(no_docs):
    assert collocations.collocations(no_docs).count() == 0
