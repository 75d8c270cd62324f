"""Centroid clustering, passage dedup and ranked search against brute force, with odd inputs."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.llm import centroids, passages, ranked
from retentia.llm.fmindex import FMIndex, WaveletMatrix

DOCS = "doc_id long, text string"
CLASH = ("key", "doc", "version", "words", "n", "m", "ranges", "start", "score", "rank", "x", "dots", "cluster", "terms", "h")


def clashing(df):
    return df.withColumns({c: F.lit("?") for c in CLASH})


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


# -- 11: centroid clustering ------------------------------------------------------

def lloyd(rows, components, n, rounds, seed):
    kept = [(k, [math.floor(1024 * float(c)) for c in v]) for k, v in rows
            if v is not None and len(v) == components and all(c is not None and math.isfinite(c) for c in v)
            and all(abs(1024 * c) < centroids.LARGEST for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:n]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]
        if step < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, c) in zip(kept, near) if c == j]
                if own:
                    centres[j] = [sum(col) // len(own) for col in zip(*own)]
    per = collections.Counter()
    for d, c in near if kept else ():
        per[c] += d
    return [(k, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
            for (k, _), (d, c) in zip(kept, near if kept else ())]


@pytest.mark.parametrize("n,rounds", [(3, 10), (8, 2), (8, 0)])
def test_clusters_against_lloyd(spark, n, rounds):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=4)]) for i in range(60)]
    rows += [(60, rows[0][1]), (60, rows[0][1]), (61, None), (62, []), (63, [1.0, 2.0, 3.0]), (64, [1.0, None, 2.0, 3.0]),
             (65, [1.0, math.nan, 2.0, 3.0]), (66, [math.inf, 0.0, 0.0, 0.0]), (None, [0.5, -0.5, 0.25, -3.0]),
             (67, [0.0, 0.0, 0.0, 0.0]), (68, [1e30, 0.0, 0.0, 0.0]), (69, [-1e5, 1e5, 0.0, 0.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    truth = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    got = centroids.digest(centroids.cluster(df, components=4, n=n, rounds=rounds))
    assert in_order(got.collect()) == in_order(lloyd(truth, 4, n, rounds, centroids.SEED))


def test_clusters_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.digest(centroids.cluster(spark.createDataFrame([], schema))).collect() == []
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    found = centroids.digest(centroids.cluster(two, components=2)).collect()
    assert {(r["vec_id"], r["distance"], r["inertia"]) for r in found} == {(1, 0, 0), (2, 0, 0)}
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(20)], schema)
    assert {r["cluster"] for r in centroids.digest(centroids.cluster(same, components=2)).collect()} == {0}


# -- 12: passage dedup ------------------------------------------------------------

def test_wavelet_ranks():
    rnd = np.random.default_rng(1)
    symbols = rnd.integers(0, 11, size=300)
    matrix = WaveletMatrix(symbols, 11)
    of, at = rnd.integers(0, 11, size=200), rnd.integers(0, 301, size=200)
    assert matrix.rank(of, at).tolist() == [int((symbols[:a] == s).sum()) for s, a in zip(of, at)]


@pytest.mark.parametrize("seed", range(8))
def test_matching_statistics(seed):
    rnd = random.Random(seed)
    kinds, longest = rnd.choice([2, 3, 9]), rnd.choice([3, 5, 20])
    texts = [[rnd.randint(1, kinds) for _ in range(rnd.randint(1, 15))] for _ in range(rnd.randint(1, 12))]
    asked = [[rnd.randint(1, kinds + 1) for _ in range(rnd.randint(1, 12))] for _ in range(10)]
    asked += [t[rnd.randrange(len(t)):] + [rnd.randint(1, kinds)] for t in texts]
    width = max(map(len, asked))
    patterns = np.array([[0] * (width - len(p)) + p for p in asked])
    lengths, low, high = FMIndex([np.array(t) for t in texts], longest).matches(patterns)
    for row, p in enumerate(asked):
        for j in range(len(p)):
            at = {m: sum(t[a:a + m] == p[j:j + m] for t in texts for a in range(len(t)))
                  for m in range(1, min(longest, len(p) - j) + 1)}
            most = max((m for m, c in at.items() if c), default=0)
            column = width - len(p) + j
            assert lengths[row, column] == most
            assert not most or high[row, column] - low[row, column] == at[most]


def without_repeats(rows, window):
    split = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    least = {}
    order = lambda k: -(1 << 63) if k is None else k
    for k, words in split:
        for i in range(len(words) - window + 1):
            w, place = tuple(words[i:i + window]), (order(k), i)
            least[w] = min(least.get(w, place), place)
    out = []
    for k, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i:i + window])] < (order(k), i):
                gone.update(range(i, i + window))
        out.append((k, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    shared = [" ".join(f"w{rnd.randint(0, 40)}" for _ in range(rnd.randint(4, 30))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else f"u{rnd.randint(0, 300)}" for _ in range(rnd.randint(0, 12))]
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(60, None), (61, ""), (62, " \t\n"), (63, "one"), (64, "a a " * 300), (65, "ä ö ü " * 30),
             (7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (None, "a b c " * 20), (66, rows[7][1]),
             (67, " ".join(f"w{i % 977}" for i in range(5000))), (68, "x" * 5000)]
    return rows


@pytest.mark.parametrize("seed,window,gram,hot,tasks", [
    (0, 5, 2, 20_000, 200_000), (1, 5, 3, 3, 40), (2, 8, 8, 2, 200_000), (3, 20, 5, 20_000, 10), (4, 6, 1, 10, 50),
])
def test_passages_against_all_windows(spark, seed, window, gram, hot, tasks):
    rows = corpus(seed)
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(4))
    got = passages.remove_repeats(df, window=window, gram=gram, hot_least=hot, per_task=tasks)
    want = without_repeats(rows, window)
    assert in_order(got.select("doc_id", "n_words", "n_removed", "kept").collect()) == in_order(want)
    for r in got.collect():
        assert sum(s["high"] - s["low"] for s in r["spans"]) == r["n_removed"]


def test_passages_of_indexes_cut_small(spark, monkeypatch):
    monkeypatch.setattr(passages, "PER_INDEX", 3)
    rows = corpus(9)
    got = passages.remove_repeats(spark.createDataFrame(rows, DOCS), window=6, gram=2)
    assert in_order(got.select("doc_id", "n_words", "n_removed", "kept").collect()) == in_order(without_repeats(rows, 6))


def test_passages_of_an_empty_table(spark):
    assert passages.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


# -- 13: ranked search --------------------------------------------------------------

def terms_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(ranked.TERM, lowered)


def ranking(docs, items, k):
    held = [(key, collections.Counter(terms_of(t))) for key, t in docs]
    held = [(key, c) for key, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    queries = collections.defaultdict(set)
    for key, t in items:
        queries[key].update(terms_of(t))
    out = []
    for item, words in queries.items():
        scores = []
        for key, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in words if c[t])
            if s > 0 and key is not None:
                scores.append((-s, key))
        out += [(item, r, key, -s) for r, (s, key) in enumerate(sorted(scores)[:k], 1)]
    return out


def search_corpus(seed):
    rnd = random.Random(seed)
    words = [f"t{i}" for i in range(100)]
    draw = lambda n: " ".join(words[min(int(rnd.expovariate(0.07)), 99)] for _ in range(n))
    docs = [(i, draw(rnd.randint(0, 60))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "?!"), (3, docs[3][1]), (3, docs[3][1]), (None, draw(20)),
             (153, "T1 t1-T1,Ärger ärger"), (154, draw(20_000)), (155, "y" * 3000)]
    items = [(i, draw(rnd.randint(1, 90))) for i in range(12)]
    items += [(12, None), (13, "..."), (14, "never seen words"), (15, " ".join(words)), (1, items[1][1]), (None, "t1 t50"),
              (16, "Ärger ÄRGER"), (17, "y" * 3000)]
    return docs, items


@pytest.mark.parametrize("seed,k", [(0, 50), (1, 5), (2, 1)])
def test_ranking_against_all_pairs(spark, seed, k):
    docs, items = search_corpus(seed)
    found = ranked.top_documents(
        clashing(spark.createDataFrame(docs, DOCS).repartition(3)),
        clashing(spark.createDataFrame(items, "item_id long, text string")), k=k,
    )
    assert in_order(found.collect()) == in_order(ranking(docs, items, k))


def test_ranking_in_small_blocks_and_passes(spark, monkeypatch):
    for name, value in (("PASS_BYTES", 400), ("CELLS", 1), ("POSTINGS", 50)):
        monkeypatch.setattr(ranked, name, value)
    docs, items = search_corpus(4)
    found = ranked.top_documents(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert in_order(found.collect()) == in_order(ranking(docs, items, 7))


def test_groups_have_equal_masks():
    rnd = np.random.default_rng(2)
    present = rnd.random((150, 40)) < 0.5
    present[:, 20:] = present[:, :20]
    group, first = ranked.groups_by_mask(present)
    for a in range(40):
        for b in range(40):
            assert (group[a] == group[b]) == bool((present[:, a] == present[:, b]).all())
    assert sorted(group[first]) == sorted(set(group))


def test_ranking_of_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.top_documents(none, items).collect() == []
    assert ranked.top_documents(spark.createDataFrame([(1, "a b")], DOCS), items.where("false")).collect() == []
