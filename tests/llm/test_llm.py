"""Operators for training data: brute force, exact round trips and odd inputs."""

import collections
import hashlib
import math
import threading
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentia.llm import (
    components, covertree, hamming, jaccard, langid, lattice, licenses, mixing, pieces, registry, sharding, warc,
)
from retentia.sources.staging import new_folder

MODEL = registry.piece_model_path()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns with clashing names."""
    long_ = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [
        (1, None, "en", "a", 1), (2, "", None, None, 2), (3, "one", "en", "a", 3), (4, "one two", "de", None, 4),
        (5, long_, "en", "b", 5), (6, long_, "en", "b", 6), (7, "the cat sat on the mat", "en", "b", 7),
        (7, "the cat sat on the mat", "en", "b", 7), (8, " \t\n ", "en", "", 8), (None, "no key at all", "en", "a", 9),
        (9, "12345 !!", None, "b", 10), (10, "x" * 5000, "en", "b", 11),
    ]
    return frame(spark, rows).withColumns({n: F.lit(1) for n in ("ids", "score", "slot", "license", "_key", "size", "n")})


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def table(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((v is not None, v) for v in r))


# -- 1: near-duplicate vectors ---------------------------------------------------

def _link_truth(rows, cosine):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = [unit(v) if k is not None else None for k, v in rows]
    links = collections.defaultdict(set)
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[i].add(j)
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((key, len(links[i]), None if key is None else min(rows[j][0] for j in seen)))
    return out


@pytest.mark.parametrize("tile", [8, 4096])
def test_vectors_against_all_pairs(spark, tile):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(12, 6))
    near = [b + rnd.normal(scale=s, size=6) for b in base for s in (0.0, 0.02, 0.1, 0.2, 0.3)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(near)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, [2 * x for x in rows[0][1]]), (103, None), (104, []),
             (105, [0.0] * 6), (106, [None, 1.0]), (107, [float("nan"), 1.0]), (108, [float("inf"), 1.0]),
             (109, [1.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = covertree.near_duplicates(df, tile=tile).collect()
    want = _link_truth(rows, 0.95)
    order = lambda r: (r[0] is not None, r[0])
    assert sorted(((r[0], r[1], r[2]) for r in got), key=order) == sorted(want, key=order)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_dense_and_spread_vectors_in_deep_trees(spark):
    """Balls whose vectors all link, equal directions, and strays, in small tiles."""
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(8, 16))
    rows = [base[0] + rnd.normal(scale=.02, size=16) for _ in range(150)]
    rows += [base[1 + i % 7] + rnd.normal(scale=.3 * (i % 7) / 7, size=16) for i in range(150)]
    rows += [base[2] * (1 + i / 8) for i in range(60)] + [rnd.normal(size=16) * 1e100 for _ in range(30)]
    rows = [(7 * i % 1009, [float(x) for x in v]) for i, v in enumerate(rows)] + [(2000 + i, [1.0, i / 40]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = covertree.near_duplicates(df, tile=24).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted(_link_truth(rows, 0.95))
    leaves, steps = covertree._leaves(df.selectExpr("vec_id id", "1L weight", "embedding vector", "size(embedding) dim"), 24)
    assert leaves.groupBy("node").count().agg(F.max("count")).first()[0] <= 24 and len(steps) > 1
    assert any(pairs.count() for pairs in covertree._walk(leaves, steps, 0.95)[1])


def test_part_of_a_tree_keeps_what_is_near():
    rnd = np.random.default_rng(2)
    unit = rnd.normal(size=(300, 8))
    unit[:200] = unit[0] + rnd.normal(scale=.2, size=(200, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tree = covertree.Tree(unit)
    rows = tree.near(unit[0], .3)
    assert set(np.flatnonzero(np.linalg.norm(unit - unit[0], axis=1) <= .3)) <= set(rows) and len(rows) < 250
    part, ones = tree.part(rows), np.ones(len(rows), np.int64)
    for centres, parent, members, radius in part.levels:
        assert (np.linalg.norm(part.unit - part.unit[centres[members]], axis=1) <= radius[members] + 1e-5).all()
    count = covertree.dual_traversal(part, part, ones, ones, .95, True)[0]
    assert (count == (part.unit @ part.unit.T >= .95).sum(1) - 1).all()


def _shuffled_mb(spark):
    """MB of shuffle files on disk (local mode)."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")) / 1e6


def test_vectors_without_structure_are_not_sent_from_tile_to_tile(spark):
    """Every pair of tiles may hold links here, and yet what is shuffled stays near the size of the vectors."""
    rnd = np.random.default_rng(8)
    vectors = rnd.normal(size=(900, 48)).astype(np.float32)
    vectors[800:850] = vectors[:50] + rnd.normal(scale=.05, size=(50, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    before, most, over = _shuffled_mb(spark), [0], threading.Event()

    def watch():
        while not over.wait(.2):
            most[0] = max(most[0], _shuffled_mb(spark) - before)

    watching = threading.Thread(target=watch)
    watching.start()
    try:
        got = covertree.near_duplicates(df, tile=20).collect()
    finally:
        over.set()
        watching.join()
    unit = vectors / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    assert [r["n_links"] for r in sorted(got)] == ((unit @ unit.T >= .95).sum(1) - 1).tolist()
    assert most[0] < 5 * vectors.nbytes / 1e6


def test_tiles_in_several_blocks_and_folded_links(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    base = rnd.normal(size=(12, 6))
    rows = [(i, [float(x) for x in base[i % 12] + rnd.normal(scale=.12 * (i % 3), size=6)]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(covertree, "BLOCK", 240 * 6 * 8 // 3)
    folds, whole = [], covertree.Links.add
    monkeypatch.setattr(covertree.Links, "add", lambda self, found: (whole(self, found), folds.append(len(self.parts))))
    got = covertree.near_duplicates(df, tile=16).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted(_link_truth(rows, 0.95))
    assert len(folds) > 3 and 1 in folds[1:]


def test_few_vectors_of_another_length(spark):
    """One tile beside many keeps its links."""
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.normal(size=5)]) for i in range(60)] + [(100 + i, [1.0, i / 40]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = covertree.near_duplicates(df, tile=16).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted(_link_truth(rows, 0.95))


def test_bounds_from_leading_coordinates_drop_no_link():
    """Vectors whose first coordinates say little, or all share a large one."""
    rnd = np.random.default_rng(6)
    for shift, flat in ((0, 0), (4, 0), (0, 30)):
        unit = rnd.normal(size=(60, 40))[rnd.integers(0, 60, 500)] + rnd.normal(scale=.15, size=(500, 40))
        unit[:, :flat], unit[:, 0] = 0, unit[:, 0] + shift
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        weight = rnd.integers(1, 4, 500)
        linked = unit[:200] @ unit[200:].T >= .95
        for shape in (None, covertree.shape_of(unit)):
            a, b = covertree.Tree(unit[:200]), covertree.Tree(unit[200:])
            count_a, count_b, left, right = covertree.dual_traversal(a, b, weight[:200], weight[200:], .95, False, shape)
            assert (count_a == linked @ weight[200:]).all() and (count_b == linked.T @ weight[:200]).all()


def test_vectors_of_an_empty_table(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}}


# -- 2: pieces -------------------------------------------------------------------

def test_pieces_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(5)
    letters = ["a", "e", "th", " ", "  ", "▁", "\n", "é", "中", "😀", "=", "the", "1", "\x00", "aaaa", "한", "\t"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["=" * 999, " " * 77, "", "ab" * 2000]
    ids, counts, decoded = pieces.Encoder(pieces.PieceModel(MODEL)).batch(texts)
    ends = np.cumsum(counts)
    for text, end, n, back in zip(texts, ends, counts, decoded):
        want = library.encode(text)
        assert ids[end - n:end].tolist() == want and back == library.decode(want)


def test_pieces_of_odd_texts(odd, empty):
    got = {r["n_chars"]: r for r in pieces.encode_decode(odd, MODEL).collect()}
    assert len(got) == odd.distinct().count() and list(got[1]["ids"]) == [2] and got[1]["decoded"] == ""
    assert got[5]["decoded"] == got[6]["decoded"] and got[8]["decoded"] == " \t\n "
    assert pieces.encode_decode(empty, MODEL).count() == 0


# -- 3: scores --------------------------------------------------------------------

def test_lattice_sums_all_cuts():
    parts = [b" a", b"b", b" ab", b"c", b"bc", b" ", b"a"]
    scores = np.log(np.array([.2, .1, .15, .05, .1, .3, .1]))

    def brute(raw):
        return 1.0 if not raw else sum(
            math.exp(s) * brute(raw[len(p):]) for p, s in zip(parts, scores) if raw.startswith(p)
        )

    model = lattice.Lattice(parts, scores)
    words = [b"abc", b"ab", b"a", b"abab", b"abc"]
    assert np.allclose(np.exp(model.log_probabilities(words)), [brute(b" " + w) for w in words])
    counts = model.expected_counts([b"abc"], np.array([2.0]))
    assert sum(n * len(p) for n, p in zip(counts, parts)) == pytest.approx(8)


def test_weights_come_from_the_stored_scores_and_the_counts(spark):
    stored = lattice.vocabulary(MODEL)
    assert stored[b" t"] == -2 and min(stored.values()) == stored[b"\x00"] and all(bytes([v]) in stored for v in range(256))
    start = lattice.initial_weights([0.0, -2.0, -8.0])
    assert np.allclose(start, np.array([.5, .25, .1]) / .85)
    # Two rounds over three words against sums over every cut.
    pieces, words = [b" ab", b" ", b"a", b"b", b"ba"], {b"ab": 3, b"aba": 1, b"b": 2}
    start = np.array([.1, .3, .2, .2, .2])

    def cuts(raw):
        return [()] if not raw else [
            (i, *rest) for i, p in enumerate(pieces) if raw.startswith(p) for rest in cuts(raw[len(p):])
        ]

    weights, prior = start, lattice.PRIOR * len(pieces) * start
    for _ in range(2):
        expected = np.zeros(len(pieces))
        for word, n in words.items():
            found = cuts(b" " + word)
            chances = np.array([np.prod(weights[list(c)]) for c in found])
            for c, share in zip(found, n * chances / chances.sum()):
                np.add.at(expected, list(c), share)
        weights = (expected + prior) / (expected + prior).sum()
    want = np.r_[expected + prior, 4 + lattice.PRIOR]
    counts = spark.createDataFrame([(bytearray(w), c) for w, c in words.items()], "word binary, c long")
    got = lattice.piece_scores(spark, counts, pieces, start, 4)
    assert np.allclose(np.exp(got), want / want.sum())
    assert lattice.frequent_words(counts, 6) == {b" ab": .5, b" aba": 1 / 6, b" b": 2 / 6}


def test_a_text_is_scored_by_its_cuts_whether_met_or_not(spark):
    """The score of a real word, by brute force over its cuts under the learned weights."""
    rows = [(i, "the quick brown fox", "en", "a", 1) for i in range(6)] + [(9, "unheardof", "en", "a", 1)]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["score"] for r in lattice.score_texts(docs, MODEL, F.col("doc_id") < 9).collect()}
    counts = spark.createDataFrame([(bytearray(w.encode()), 6) for w in rows[0][1].split()], "word binary, c long")
    stored, words = lattice.vocabulary(MODEL), lattice.frequent_words(counts, 30)
    start = dict(zip(stored, lattice.initial_weights(list(stored.values())) * (1 - sum(words.values()) / 2)))
    for word, share in words.items():
        start[word] = start.get(word, 0.0) + share / 2
    learned = lattice.piece_scores(spark, counts, list(start), np.array(list(start.values())), 6)
    chance = dict(zip(start, np.exp(learned)))

    def total(raw):
        return 1.0 if not raw else sum(chance.get(raw[:n], 0.0) * total(raw[n:]) for n in range(1, len(raw) + 1))

    for key, text in ((0, rows[0][1]), (9, "unheardof")):
        want = sum(math.log10(total(b" " + w)) for w in text.encode().split()) + learned[-1] / math.log(10)
        assert got[key] == pytest.approx(want)


def test_scores_of_odd_texts(odd, empty):
    train = ~langid.held_out("doc_id", folds=5)
    rows = lattice.score_texts(odd, MODEL, train).collect()
    source = [(r["doc_id"], r["text"]) for r in odd.collect()]
    held = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 5 == 1
    words = lambda t: (t or "").encode().lower().split()
    count = collections.Counter(w for k, t in source if not held(k) for w in words(t))
    ends = sum(not held(k) for k, _ in source)
    whole = sum(count.values()) + ends
    base = lambda c: math.log10((c + .5) / (whole + .5 * (len(count) + 2)))
    want = sorted((k or -1, held(k), len(words(t)) + 1, sum(count[w] > 0 for w in words(t)) + 1, whole,
                   round(sum(base(count[w]) for w in words(t)) + base(ends), 6)) for k, t in source)
    got = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                  round(r["base_score"], 6)) for r in rows)
    assert got == want and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert lattice.score_texts(empty, MODEL, train).count() == 0


# -- 4, 5: licences and codes are compared with SQL in tests/test_contract.py --------------

def test_licences_in_odd_texts(spark, odd, empty):
    assert {r["license"] for r in licenses.scan_licenses(odd).collect()} == {None}
    assert licenses.scan_licenses(empty).count() == 0
    text = "Prose.\n\nReleased under the\nMIT License.\n\nMore.\nAll Rights RESERVED"
    found = licenses.scan_licenses(frame(spark, [(1, text, "en", "a", 1)])).first()
    assert found["licenses"] == "MIT-notice,all-rights-reserved" and found["dice"] == 1.0
    assert licenses.Scanner(licenses.TEMPLATES, .8).candidates(3) == [
        t for t in licenses.Scanner(licenses.TEMPLATES, .8).templates if 2 * min(3, len(t[1])) >= .8 * (3 + len(t[1]))
    ]


def _licence_texts():
    mit, apache = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["Apache-2.0-header"][0].split()
    isc = licenses.TEMPLATES["ISC"][0].split()
    comment = "\n".join(" * " + " ".join(apache[i:i + 9]) for i in range(0, len(apache), 9))
    prose = " ".join(f"word{i * i % 83} of the" for i in range(200))
    return {
        "readme": f"# Tool\n\n{prose}\n\n" + mit.replace(". ", ".\n\n") + f"\n\n{prose}",
        "comment": f"/*\n{comment}\n */\nint main() {{ return 0; }}\n{prose}",
        "sentence": f"{prose} and it is released under the MIT License, as all of ours are. {prose}",
        "changed": " ".join([prose, *isc[:20], "changed", "here", *isc[22:60], "again", *isc[60:], prose]),
        "half": " ".join([prose, *isc[:len(isc) // 2], prose]),
        "twice": f"{prose} all rights reserved all rights reserved {prose} all rights are reserved",
        "prose": prose,
    }


def test_licences_inside_longer_texts(spark):
    texts = _licence_texts()
    rows = [(i, t, "en", "a", i) for i, t in enumerate([*texts.values(), None, "", "one"])]
    found = licenses.scan_licenses(frame(spark, rows))
    names = dict(zip([*texts, "null", "empty", "one"], [r["licenses"] for r in found.orderBy("doc_id").collect()]))
    assert names == {
        "readme": "MIT", "comment": "Apache-2.0-header,Apache-2.0-notice", "sentence": "MIT-notice", "changed": "ISC",
        "half": "", "twice": "all-rights-reserved", "prose": "", "null": "", "empty": "", "one": "",
    }
    with duckdb.connect() as db:
        documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
        db.register("documents", documents)
        wanted = sorted(db.execute(licenses.oracle_sql()).fetchall())
    assert sorted(tuple(r) for r in found.select("doc_id", "license", "dice", "n_licenses", "licenses").collect()) == wanted


def test_licence_windows_against_all_windows():
    templates = {"a": ["one two three four two three five"], "b": ["two three", "one two three one two"], "c": ["four five six"]}
    rng = np.random.default_rng(4)
    for _ in range(300):
        scanner = licenses.Scanner(templates, float(rng.choice([.5, .8])))
        found = list(rng.choice(["one", "two", "three", "four", "five", "six", "seven"], rng.integers(0, 25)))
        wanted = {}
        for name, texts in templates.items():
            for own in map(str.split, texts):
                grams = licenses.bigrams(own)
                for i in [*range(len(found) - len(own) + 1), None]:
                    part = licenses.bigrams(found if i is None else found[i:i + len(own)])
                    dice = 2.0 * len(part & grams) / (len(part) + len(grams))
                    if dice >= scanner.threshold:
                        wanted[name] = max(dice, wanted.get(name, 0.0))
        assert scanner.scan(" ".join(found)) == wanted


def test_segments_follow_the_index():
    for bits in (1, 5, 64, 200):
        for codes in (0, 1, 300, 10_000, 10 ** 12):
            widths = hamming.segment_widths(bits, codes)
            assert sum(widths) == bits and max(widths) <= hamming.MOST and max(widths) - min(widths) <= 1
    counts = [len(hamming.segment_widths(64, 10 ** n)) for n in range(3, 13)]
    assert counts == sorted(counts, reverse=True) and counts[-1] == 2


def test_work_of_a_search_is_what_it_probes():
    for bits, codes, reach in ((16, 500, 5), (64, 50_000, 18), (13, 10, 13)):
        for count in range(1, bits + 1):
            widths = hamming._widths(bits, count)
            wanted = sum(
                math.comb(w, r) * (1 + codes / 2 ** w)
                for i, w in enumerate(widths) for r in range(w + 1) if count * r + i <= reach
            )
            assert hamming.search_work(bits, count, codes, reach) == pytest.approx(wanted)
    codes = np.random.default_rng(5).integers(0, 2, (2_000, 64))
    distances = np.sort((codes[:50, None] != codes[None]).sum(2), axis=1)[:, 10]
    assert abs(np.median(distances) - hamming._kth_distance(64, 2_000, 11)) <= 1


@pytest.mark.parametrize("width, radius", [(1, 0), (1, 1), (7, 3), (10, 10), (13, 6)])
def test_masks_are_all_values_with_so_many_bits(spark, width, radius):
    parts = spark.range(1).select(hamming._masks(width, radius).alias("m")).first()["m"]
    got = sorted(a | b for p in parts for a in p["low"] for b in p["high"])
    assert got == [v for v in range(1 << width) if v.bit_count() == radius]


# Codes of wide segments, of uneven ones, and of one bit each.
@pytest.mark.parametrize("bits, widths", [(20, [10, 10]), (48, [16] * 3), (23, [12, 11]), (6, [1] * 6)])
def test_codes_against_all_pairs(spark, bits, widths):
    rnd = random.Random(bits)
    codes = [rnd.getrandbits(bits) for _ in range(60)]
    rows = [(i, codes[i % 60] ^ (rnd.getrandbits(bits) & rnd.getrandbits(bits) & rnd.getrandbits(bits))) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]
    vectors = [(i, [1.0 if c >> b & 1 else -1.0 for b in range(bits)]) for i, c in rows] + [(999, None), (None, [1.0])]
    made = hamming.sign_codes(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), widths).cache()
    got = table(hamming.top_k(made, made.where("id % 10 = 0"), widths, 5), "query_id", "rank", "id", "distance")
    want = []
    for q, code in rows:
        if q % 10 == 0:
            near = sorted(((code ^ c).bit_count(), i) for i, c in rows if i != q)[:5]
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert got == sorted(want)
    none = made.where("id < 0")
    assert hamming.top_k(none, none, widths, 5).count() == 0


# -- 6: language --------------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    content = langid.dictionaries(docs.where(~langid.held_out("doc_id")))
    found = langid.identify(docs, content).where(langid.held_out("doc_id")).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    assert np.mean([r["rejected"] for r in found]) < 0.02 and all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_texts(odd, empty):
    got = {r["n_chars"]: r for r in langid.identify(odd, langid.dictionaries(odd)).collect()}
    assert {got[k]["lang_pred"] for k in (1, 2, 8, 10)} == {"und"} and got[7]["lang_pred"] in ("de", "en")
    assert {r["lang_pred"] for r in langid.identify(odd, langid.dictionaries(empty)).collect()} == {"und"}


# -- 7: Jaccard ---------------------------------------------------------------------

def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())


def _jaccard_truth(rows):
    sets = [_shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                label[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows)))


@pytest.mark.parametrize("cost", [1 << 25, 1 << 18])
def test_jaccard_against_all_pairs(spark, monkeypatch, cost):
    monkeypatch.setattr(jaccard, "TILE_COST", cost)  # small: several tiles in a family
    monkeypatch.setattr(jaccard, "LEAF", 20)  # small: regions join recursively
    monkeypatch.setattr(jaccard, "BATCH_BYTES", 2_000)  # small: several batches of regions
    rnd = random.Random(cost)
    texts = []
    for size in (4, 9, 12, 30, 60, 120, 200):
        base = [rnd.choice("abcdefghij") + str(rnd.randint(0, 400)) for _ in range(size)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, size // 20))):
                copy[rnd.randrange(size)] = f"new{rnd.randint(0, 9)}"
            texts.append(" ".join(copy[:size - rnd.randint(0, 2)]))
    rows = list(enumerate(texts + ["one", "ONE", "one two", "", None, " \n "]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id") == _jaccard_truth(rows)


def test_linked_sets_share_a_region():
    rnd = np.random.default_rng(1)
    for _ in range(400):
        n = int(rnd.integers(1, 400))
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        gone = int(rnd.integers(0, len(a) // 10 + 1))
        b = np.unique(np.r_[a[gone:], rnd.integers(0, 1 << 63, int(rnd.integers(0, 3))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert set(jaccard.regions(a).tolist()) & set(jaccard.regions(b).tolist())


def test_jaccard_of_odd_texts(odd, empty):
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(odd).collect()}
    assert got[6]["component_id"] == 5 and got[1]["n_shingles"] == 0 and got[None]["component_id"] is None
    assert jaccard.jaccard_components(empty).count() == 0
    assert jaccard.keep_first(odd).count() == odd.count() - 1


# -- 8: shards ----------------------------------------------------------------------

def test_curve_is_a_hilbert_curve(spark):
    points = spark.range(16).select(*[(F.floor(F.col("id") / 2**i) % 2).cast("int").alias(c) for i, c in enumerate("abcd")])
    grid = spark.range(4096).select(
        (F.col("id") % 16).cast("int").alias("x"), (F.floor(F.col("id") / 16) % 16).cast("int").alias("y"),
        F.floor(F.col("id") / 256).cast("int").alias("z"),
    )
    for df, names, bits in ((points, "abcd", 1), (grid, "xyz", 4)):
        placed = df.withColumn("h", sharding.hilbert_index([F.col(c) for c in names], bits)).orderBy("h").collect()
        assert [r["h"] for r in placed] == list(range(len(placed)))
        steps = [sum(abs(p[c] - q[c]) for c in names) for p, q in zip(placed, placed[1:])]
        assert set(steps) == {1}


def test_shards_are_even_and_gapless(odd, empty, spark):
    for docs, shards in ((odd, 5), (spark.read.parquet(f"{SF}/documents.parquet"), 40)):
        got = sharding.hilbert_shards(docs, shards).collect()
        sizes = collections.Counter(r["shard"] for r in got)
        assert len(got) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == shards
        slots = collections.defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
        assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]])) for r in got)
    assert sharding.hilbert_shards(empty).count() == 0


# -- 9: mixing ------------------------------------------------------------------------

def test_targets_equal_repeated_resharing(spark):
    rnd = random.Random(2)
    for _ in range(3):
        sizes = {f"s{i:02}": rnd.randint(0, 1000) for i in range(9)} | {None: 50}
        rows = [(s, n) for s, n in sizes.items()]
        got = {r["_source"]: r["target"] for r in mixing.source_targets(
            spark.createDataFrame(rows, "_source string, size long")).collect()}
        names = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        want, open_ = dict.fromkeys(names, 0.0), set(names)
        rest = 1.5 * sum(sizes.values())
        while True:
            level = rest / sum(weight[s] for s in open_)
            over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
            if not over:
                break
            for s in over:
                want[s] = 2.0 * sizes[s]
                rest -= want[s]
            open_ -= over
        for s in open_:
            want[s] = level * weight[s]
        assert got == pytest.approx(want)


def test_mix_meets_targets_and_repeats(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.sample_copies(docs).collect()
    assert table(mixing.sample_copies(docs.repartition(3)), "doc_id", "taken") == sorted((r["doc_id"], r["taken"]) for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
    assert mixing.sample_copies(odd).count() == odd.count() and mixing.sample_copies(empty).count() == 0
    taken = sum(r["copies"] for r in mixing.sample_copies(odd).collect())
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == taken


# -- 10: WARC ---------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    body = "<p>" + "a page " * 40
    rows = [(i, f"http://x/{i}", f"{body}{i % 7}") for i in range(60)]
    rows += [(70, None, None), (71, "http://a\r\nb: c", ""), (72, "u", "short"), (73, "u", "short"), (None, "u", body), (80, "u", body),
             (80, "v", body), (90, "u", "é" * 3000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload_digest", F.lit("clash"))
    folder = new_folder(spark, "warc")
    warc.write_archives(warc.record_plan(pages), warc.train_dictionary(pages), folder, archive_bytes=600)
    got = warc.read_archives(spark, folder).collect()
    first = {}
    for key, _, html in rows:
        first[html] = min(first.get(html, 10**9), 10**9 if key is None else key)
    assert len(got) == len(rows)
    kinds = collections.Counter()
    for r in got:
        html = next(h for k, u, h in rows if k == r["page_id"])
        raw = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        if r["record_type"] == "revisit":
            assert len(raw) >= 100 and r["refers_to"] == first[html] and r["html"] is None
        else:
            assert r["refers_to"] is None and bytes(r["html"]) == raw
        kinds[r["page_id"], r["record_type"]] += 1
    assert kinds[80, "response"] == 1 and kinds[80, "revisit"] == 1 and kinds[None, "revisit"] == 1
    empty = spark.createDataFrame([], PAGES)
    folder = new_folder(spark, "warc")
    warc.write_archives(warc.record_plan(empty), warc.train_dictionary(empty), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_bad_records_are_refused():
    digest = hashlib.sha256(b"hello").hexdigest()
    good = warc.encode_record(1, "u", b"hello", digest, "response", None)
    assert warc.decode_record(good)["html"] == b"hello"
    for bad in (good[:-1], good.replace(b"hello", b"hullo"), good.replace(b"WARC/1.1", b"WARC/9"),
                good.replace(b"WARC-Date", b"WARC-Dote"), good + b"x"):
        with pytest.raises(ValueError):
            warc.decode_record(bad)
    for archive in (b"", b"\x28\xb5\x2f\xfd0000", warc.leading_frame(b"abc")[:-1]):
        with pytest.raises(ValueError):
            list(warc.records_of(archive))


# -- pipeline ----------------------------------------------------------------------------

def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, kept, SF)
        assert kept.columns == docs.columns, name
    out = corpus_pipeline.run(spark, SF)
    assert {"ids", "decoded"} <= set(out.columns)
    plain = out.where(~F.col("text").contains("▁"))
    assert plain.where("decoded != text").count() == 0 and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
