"""Clashing columns, empty tables, extreme keys, foreign archives and runs without a space."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from retentia.llm import jaccard, langid, mixing, pieces, registry, sharding, warc
from retentia.sources.staging import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
CLASH = (
    "_k", "_K2", "_gone", "_letters", "_letters_", "_row", "_copies", "_copy", "_i", "k", "s", "n", "h", "r", "size", "score",
    "rejected", "lang_pred", "key", "id", "rep", "u", "v", "digest", "family", "component", "one", "nth", "target", "taken",
)
LINES = ["the cat sat on the mat and looked at the dog", "der Hund lief schnell durch den Wald und bellte", "one", "two words"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, LINES[i % 4] + (f" number {i}" if i % 3 else ""), ["en", "de", "en", "en"][i % 4], ["a", "b", None][i % 3], i)
            for i in range(40)]
    rows += [(50, None, "en", "a", 0), (51, "", None, "b", 0), (None, LINES[0], "en", None, 1), (52, "word " * 20_000, "en", "a", 9)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_stages_with_clashing_columns(spark, docs, name, step):
    """Extra columns pass through and change no decision."""
    extra = docs.withColumns({c: F.lit("?") for c in CLASH})
    assert sorted(r[0] or -1 for r in step(spark, extra, SF).select("doc_id").collect()) == sorted(
        r[0] or -1 for r in step(spark, docs, SF).select("doc_id").collect())
    if name != "tokens":
        assert step(spark, extra, SF).columns == extra.columns


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_stages_of_empty_tables(spark, docs, name, step):
    assert step(spark, docs.where("false"), SF).collect() == []


def test_copies_do_not_depend_on_how_rows_are_dealt(spark):
    """Rows equal in key, source and size: each keeps its own number of copies."""
    rows = [(1, f"w{i} x", "en", "a", i) for i in range(6)] + [(2, f"w{i} x y", "en", "b", i) for i in range(30)]
    found = []
    for parts in (1, 3, 7):
        df = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), DOCS).repartition(parts)
        found.append(sorted(tuple(r) for r in mixing.mixed_documents(df).collect()))
    assert found[0] == found[1] == found[2]


def test_mixed_texts_are_shuffled_once(spark):
    """Where the copies are too many to broadcast; null keys and sources are joined as well."""
    rows = [(i, f"w{i} x", "en", "abc"[i % 3], i) for i in range(60)] + [
        (None, "u v", "en", "a", 1), (None, "u w", "en", "a", 1), (7, "u v w", "en", None, 1), (None, None, None, None, 1)
    ]
    docs = spark.createDataFrame(rows, DOCS)
    before = {n: spark.conf.get(n) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mixed = mixing.mixed_documents(docs)
        todo, moved = [mixed._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            moved += node.nodeName() == "Exchange" and "_row" in node.output().mkString(",")
        got = sorted(map(str, mixed.collect()))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert moved == 1
    found = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mixing.sample_copies(docs).where("doc_id IS NOT NULL").collect()}
    kept = mixing.mixed_documents(docs).collect()
    assert sorted(map(str, kept)) == got
    for (key, source, _), copies in found.items():
        assert sum(r["doc_id"] == key and r["source"] == source for r in kept) == copies
    assert sum(r["doc_id"] is None for r in kept) == mixing.sample_copies(docs).where("doc_id IS NULL").agg(F.sum("copies")).first()[0]


def test_a_share_above_the_cap_takes_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 20), (None, 5)], "_source string, size long")
    got = mixing.source_targets(sizes, share=3.0, cap=2)
    assert {r["_source"]: r["target"] for r in got.collect()} == {"a": 20.0, "b": 40.0, None: 10.0}


def test_copies_against_one_pass_over_the_rows(spark, docs):
    """Copies worked out in plain Python from targets, order and offset."""
    with_hash = docs.select("doc_id", "source", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h"))
    hashes = {(r["doc_id"], r["source"]): r["h"] for r in with_hash.collect()}
    got = mixing.sample_copies(docs).collect()
    names = spark.createDataFrame([("=a",), ("=b",), ("",)], "n string")
    offsets = {r["n"]: (r["o"] % 2**52) / 2.0**52 for r in names.select("n", F.xxhash64(F.lit(mixing.SEED), "n").alias("o")).collect()}
    for source in ("a", "b", None):
        rows = [r for r in got if r["source"] == source]
        rows.sort(key=lambda r: (r["size"], hashes[r["doc_id"], source], r["doc_id"] is not None, r["doc_id"]))
        each = rows[0]["target"] / rows[0]["source_size"]
        offset = offsets["" if source is None else f"={source}"]
        upto = [int(np.floor(offset + i * each)) for i in range(len(rows) + 1)]
        assert [r["copies"] for r in rows] == [b - a for a, b in zip(upto, upto[1:])]


@pytest.mark.parametrize("keys", [
    [-(1 << 63), (1 << 63) - 1, 0, 5], [(1 << 63) - 1], [-(1 << 63), None], [0, 1, 2, 3],
])
def test_shards_of_keys_at_the_ends_of_the_range(spark, keys):
    df = spark.createDataFrame([(k, f"t{i}", "en", "a", 1) for i, k in enumerate(keys)], DOCS)
    got = sharding.hilbert_shards(df, shards=3).collect()
    assert sorted(r["position"] for r in got) == list(range(len(keys)))
    assert {(r["doc_id"], r["text_crc32"]) for r in got} == {(k, zlib.crc32(f"t{i}".encode())) for i, k in enumerate(keys)}


def test_written_shards_let_readers_skip_files(spark):
    rows = [(i, f"text {i % 11} " * (1 + i % 7), ["en", "de"][i % 2], f"s{i % 8}", 1) for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    folder = new_folder(spark, "shards")
    placed = sharding.hilbert_shards(df, shards=16)
    sharding.write_shards(df, placed, folder)
    back = spark.read.parquet(folder)
    assert back.count() == 4000 and back.select("shard").distinct().count() == 16
    assert sorted(map(tuple, back.select("doc_id", "shard").collect())) == sorted(map(tuple, placed.select("doc_id", "shard").collect()))
    # A source stands in few shards, by whose statistics the others are passed over.
    ranges = back.groupBy("shard").agg(F.min("source").alias("low"), F.max("source").alias("high")).collect()
    assert sum(r["low"] <= "s3" <= r["high"] for r in ranges) <= 6


def test_language_is_the_smallest_compressed_size(spark, docs):
    """Sizes by the library itself: one compressor per language with its raw dictionary."""
    content = langid.dictionaries(docs)
    got = langid.identify(docs, content).where("lang_pred != 'und'").collect()
    assert len(got) > 30
    classifier = langid.Classifier(content)
    for r in got[:12]:
        assert sorted(classifier.names) == ["de", "en"]
        sizes = dict(zip(classifier.names, classifier.sizes(r["text"])))
        best, other = sorted(sizes.values())
        assert sizes[r["lang_pred"]] == best and r["score"] == pytest.approx(1 - best / other)


# -- archives from elsewhere -------------------------------------------------------

def record(kind, id_, block, *more, date="2023-05-06T07:08:09Z"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{id_}>", f"WARC-Date: {date}", *more, f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("dictionary", [False, True])
def test_archive_from_elsewhere(spark, tmp_path, dictionary):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    records = [
        record("warcinfo", "a", b"software: other\r\n"), record("request", "b", b"GET / HTTP/1.1\r\n\r\n"),
        record("response", "c", http + b"<p>hi</p>", "WARC-Target-URI: http://x/", "WARC-Payload-Digest: sha1:"
               + __import__("base64").b32encode(hashlib.sha1(b"<p>hi</p>").digest()).decode()),
        record("metadata", "d", b"k: v"),
        record("revisit", "e", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", "WARC-Refers-To: <urn:uuid:c>", date="2023-05-06T07:08:09.25Z"),
    ]
    words, lead = None, b""
    if dictionary:
        raw = b"WARC/1.0 WARC-Type: response WARC-Record-ID: HTTP/1.1 200 OK " * 4
        words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        lead = warc.leading_frame(raw)
    packer = zstandard.ZstdCompressor(dict_data=words)
    (tmp_path / "crawl.warc.zst").write_bytes(lead + b"".join(packer.compress(r) for r in records))
    (tmp_path / "notes.txt").write_text("no archive")
    got = warc.read_archives(spark, str(tmp_path), "*.warc.zst").orderBy("record_id").collect()
    assert [(r["record_type"], r["record_id"], r["refers_to_id"], r["page_id"], r["payload_bytes"]) for r in got] == [
        ("response", "<urn:uuid:c>", None, None, 9), ("revisit", "<urn:uuid:e>", "<urn:uuid:c>", None, 9)]
    assert bytes(got[0]["html"]) == b"<p>hi</p>" and got[0]["payload_digest"] == hashlib.sha256(b"<p>hi</p>").hexdigest()


def test_broken_headers_are_value_errors():
    digest = hashlib.sha256(b"hello").hexdigest()
    good = warc.encode_record(1, "u", b"hello", digest, "response", None)
    visit = warc.encode_record(1, "u", b"hello", digest, "revisit", 0)
    cases = [good.replace(b"2024-01-01T00:00:00Z", b"yesterday"), good.replace(b"2024-01-01", b"2024-04-31"),
             good.replace(b"WARC-Type: response", b"WARC-Type: surprise"),
             good.replace(b"Content-Length: 5", b"Content-Length: x"),
             good.replace(b"Content-Length: 5", b"Content-Length: 6")]
    cut = b"Content-Length: 5\r\n"
    length = len(visit.partition(b"\r\n\r\n")[2]) - 4
    cases.append(visit.replace(cut, b"").replace(b"Content-Length: %d" % length, b"Content-Length: %d" % (length - len(cut))))
    for bad in cases:
        with pytest.raises(ValueError):
            warc.decode_record(bad)


# -- runs without a space ------------------------------------------------------------

@pytest.mark.parametrize("limit", [pieces.LONG_RUN, 0])
def test_long_runs_are_encoded_as_the_library_does(monkeypatch, limit):
    monkeypatch.setattr(pieces, "LONG_RUN", limit)
    path = registry.piece_model_path()
    library, rnd = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(7)
    texts = ["x" * 5000, " " * 3000, "=" * 900 + "word" * 500, "", "a"]
    for letters in ("abcdefghijklmnopqrstuvwxyz0123456789+/", "ab", "é中文漢字abc", "01", "aA \t\n"):
        texts += ["".join(rnd.choice(letters) for _ in range(n)) for n in (3, 700, 2500)]
    ids, counts, decoded = pieces.Encoder(pieces.PieceModel(path)).batch(texts)
    ends = np.cumsum(counts)
    for text, end, n, back in zip(texts, ends, counts, decoded):
        want = library.encode(text)
        assert ids[end - n:end].tolist() == want and back == library.decode(want)
