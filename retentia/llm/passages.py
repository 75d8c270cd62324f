"""Substring dedup: word passages that stand earlier in the corpus are removed.

A window is a run of consecutive words.  Each document is cut into passages: runs of
windows whose smallest word gram, by hash, is the same one.  Equal windows hold equal
grams, so their passages go to the same shard and only there can they meet.  A shard
indexes its distinct passages in a compressed FM-index, streams them through it and
reports the windows that occur earlier.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from retentia.llm.common import partitions
from retentia.llm.fmindex import FMIndex
from retentia.sources.staging import forget_shuffles, release, stage

WINDOW = 20
GRAM = 5
CHUNK_BYTES = 1 << 20       # text cut at once
LOCAL = 1 << 20             # passages whose grams are counted at once
PER_TASK = 200_000          # passages a shard's task reads, about 30 MB
PER_INDEX = 20_000          # distinct passages of one index, or those of one gram if they are more
HOT_LEAST, HOT_SHARE = 20_000, 100_000  # a hot gram has more passages than both; so at most 100,000 are hot
NO_KEY = -(1 << 63)         # stands for a null key, which counts as the smallest
_OUTER, _INNER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes scattered further, so that their order says nothing about the words."""
    h = (h ^ (h >> np.uint64(29))) * _INNER
    return h ^ (h >> np.uint64(32))


def _spaces() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


_SPACE = _spaces()


def _word_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words, eight bytes at a time; they only say where passages are sent."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray(buffer=padded, dtype="<u8", shape=(len(data) + 1,), strides=(1,))
    h = size.astype(np.uint64) * _INNER
    todo, done = np.arange(len(first)), 0
    while len(todo):
        left = size[todo] - done
        lane = lanes[first[todo] + done]
        short = left < 8
        lane[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        h[todo] = _mixed((h[todo] ^ lane) * _OUTER)
        todo, done = todo[left > 8], done + 8
    return h


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for j in range(size):
        out = out * _OUTER + h[j:j + len(out)]
    return _mixed(out)


class Cut:
    """The words and passages of the texts `data[bounds[i]:bounds[i + 1]]`, all numbered through.

    first, last: bytes of each word; begins: first word of each text.  Passages: owner
    (text), at (first word), count (windows), key (hash of the gram they share).
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, window: int, gram: int):
        self.data, self.window = data, window
        letter = ~_SPACE[data]
        opens, closes = letter.copy(), letter.copy()
        opens[1:] &= ~letter[:-1]
        closes[:-1] &= ~letter[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        opens[inner] = letter[inner]
        closes[inner - 1] = letter[inner - 1]
        self.first, self.last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.begins = np.searchsorted(self.first, bounds)
        self.hashes = _word_hashes(data, self.first, self.last - self.first)
        self._passages(gram)

    def _passages(self, gram):
        window = self.window
        n = max(0, len(self.hashes) - window + 1)
        grams = _grams(self.hashes, gram)
        # Leftmost place of the smallest gram among the first `span` of every window.
        width, span, place = window - gram + 1, 1, np.arange(len(grams))
        while span < width and n:
            step = min(span, width - span)
            a, b = place[:len(place) - step], place[step:]
            place = np.where(grams[a] <= grams[b], a, b)
            span += step
        place = place[:n]
        owner = np.repeat(np.arange(len(self.begins) - 1), np.diff(self.begins))
        inside = owner[:n] == owner[window - 1:window - 1 + n]
        fresh, ends = inside.copy(), inside.copy()
        moved = place[1:] != place[:-1]
        fresh[1:] &= moved | ~inside[:-1]
        ends[:-1] &= moved | ~inside[1:]
        self.at = np.flatnonzero(fresh)
        self.count = np.flatnonzero(ends) - self.at + 1
        self.owner, self.key = owner[self.at], grams[place[self.at]]

    def window_keys(self, at: np.ndarray) -> np.ndarray:
        """Keys of the windows that start at the words `at`."""
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(self.window):
            out = out * _INNER + self.hashes[at + j]
        return _mixed(out)

    def texts(self, at: np.ndarray, count: np.ndarray) -> list:
        """The bytes from word `at` to the last word of `count` windows."""
        raw = self.data.tobytes()
        low, high = self.first[at].tolist(), self.last[at + count + self.window - 2].tolist()
        return [raw[a:b] for a, b in zip(low, high)]


def _chunks(batch):
    """Slices of a batch of about CHUNK_BYTES of text each: rows from, to, bytes, bounds of the texts."""
    texts = pc.fill_null(batch["text"], "")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK_BYTES, side="right")) - 1)
        yield low, high, data[bounds[low]:bounds[high]], bounds[low:high + 1] - bounds[low]
        low = high


def _counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, n): passages per gram, left out where a gram is alone among LOCAL; null: all passages."""
    def work(batches):
        held, size, total = [], 0, 0

        def counted():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(keys[some].view(np.int64)), pa.array(n[some])], names=["key", "n"]
            )

        for batch in batches:
            for _, _, data, bounds in _chunks(batch):
                held.append(Cut(data, bounds, window, gram).key)
                size, total = size + len(held[-1]), total + len(held[-1])
                if size >= LOCAL:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], names=["key", "n"])

    return docs.select("text").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


_PLACE = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("version", T.LongType()),
    T.StructField("start", T.IntegerType()),
])


def _places(docs: DataFrame, window: int, gram: int, hot: np.ndarray) -> DataFrame:
    """Where the passages of all grams but hot ones start."""
    def work(batches):
        for batch in batches:
            doc, version = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc", "version"))
            for low, high, data, bounds in _chunks(batch):
                cut = Cut(data, bounds, window, gram)
                cool = ~np.isin(cut.key, hot)
                owner = cut.owner[cool]
                yield pa.RecordBatch.from_arrays([
                    pa.array(cut.key[cool].view(np.int64)), pa.array(doc[low:high][owner]),
                    pa.array(version[low:high][owner]), pa.array((cut.at[cool] - cut.begins[owner]).astype(np.int32)),
                ], names=_PLACE.names)

    return docs.select("text", "doc", "version").mapInArrow(work, _PLACE)


def _shared(batches):
    """Task over places sorted by key: those whose gram another passage has as well."""
    last = None
    names = _PLACE.names[1:]
    for batch in batches:
        if not batch.num_rows:
            continue
        # The last row waits for the next batch, as that may go on with its key.
        table = pa.Table.from_batches([batch]) if last is None else pa.concat_tables([last, pa.Table.from_batches([batch])])
        key = table["key"].to_numpy()
        same = key[1:] == key[:-1]
        twin = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if last is not None:
            twin[0] |= was
        was, last = bool(twin[-1]), table.slice(len(key) - 1)
        for part in table.slice(0, len(key) - 1).filter(pa.array(twin[:-1])).select(names).to_batches():
            yield part
    if last is not None and was:
        yield from last.select(names).to_batches()


_PASSAGE = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("doc", T.LongType()),
    T.StructField("version", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()),
])


def _rows(cut, at, count, key, owner, words, doc, version):
    return pa.RecordBatch.from_arrays([
        pa.array(key.view(np.int64)), pa.array(words, pa.binary()), pa.array(doc[owner]), pa.array(version[owner]),
        pa.array((at - cut.begins[owner]).astype(np.int32)), pa.array(count.astype(np.int32)),
    ], names=_PASSAGE.names)


def _hot_windows(cut, hot):
    """The single windows of a cut's passages with hot grams: first word, text number, words joined by spaces."""
    split = np.isin(cut.key, hot)
    at = np.repeat(cut.at[split], cut.count[split]) + _within(cut.count[split])
    words = [b" ".join(w.split()) for w in cut.texts(at, np.ones(len(at), dtype=np.int64))]
    return at, np.repeat(cut.owner[split], cut.count[split]), words


def _first_places(docs: DataFrame, window: int, gram: int, hot: np.ndarray, bound: int) -> dict:
    """Windows of hot grams that are as frequent themselves, and where each stands first."""
    def work(batches):
        for batch in batches:
            doc, version = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc", "version"))
            for low, high, data, bounds in _chunks(batch):
                cut = Cut(data, bounds, window, gram)
                at, owner, words = _hot_windows(cut, hot)
                ones = np.ones(len(at), dtype=np.int64)
                yield _rows(cut, at, ones, cut.window_keys(at), owner, words, doc[low:high], version[low:high])

    found = docs.select("text", "doc", "version").mapInArrow(work, _PASSAGE).groupBy("words").agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("place")
    )
    # All passages have `window - gram + 1` windows at most, so at most HOT_SHARE rows come back.
    rows = found.where(F.col("n") > bound * (window - gram + 1)).collect()
    return {bytes(r["words"]): (r["place"]["doc"], r["place"]["start"]) for r in rows}


def _passages(docs: DataFrame, window: int, gram: int, hot: np.ndarray, known: dict) -> DataFrame:
    """The passages at `starts`, and those of hot grams cut further, to single windows not in `known`."""
    def work(batches):
        for batch in batches:
            doc, version = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc", "version"))
            for low, high, data, bounds in _chunks(batch):
                cut = Cut(data, bounds, window, gram)
                wanted = np.zeros(len(cut.first) + 1, dtype=bool)
                for i, starts in enumerate(batch["starts"].slice(low, high - low)):
                    if starts.is_valid:
                        wanted[cut.begins[i] + starts.values.to_numpy()] = True
                use = wanted[cut.at]
                at, count = cut.at[use], cut.count[use]
                place = doc[low:high], version[low:high]
                yield _rows(cut, at, count, cut.key[use], cut.owner[use], cut.texts(at, count), *place)
                if len(hot):
                    at, owner, words = _hot_windows(cut, hot)
                    new = np.array([w not in known for w in words], dtype=bool)
                    at, owner, words = at[new], owner[new], [w for w, k in zip(words, new) if k]
                    yield _rows(cut, at, np.ones(len(at), dtype=np.int64), cut.window_keys(at), owner, words, *place)

    return docs.select("text", "doc", "version", "starts").mapInArrow(work, _PASSAGE)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count-1 for every count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def earlier_windows(passages: list, docs: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Which windows of distinct passages stand earlier in another: a matrix [passage, window].

    Passages are words with white space between; docs and starts are where each stands first.
    """
    ids = {}
    sequences = [np.array([ids.setdefault(w, len(ids) + 1) for w in p.split()], dtype=np.int64) for p in passages]
    sizes = np.array([len(s) for s in sequences])
    index = FMIndex(sequences, window)
    # A place of the text as one number: document, then word.
    _, rank = np.unique(docs, return_inverse=True)
    first = (rank.astype(np.int64) << 32) + starts
    where = np.repeat(first, sizes + 1) + _within(sizes + 1)
    least = index.smallest(where)
    width = int(sizes.max())
    patterns = np.zeros((len(sequences), width), dtype=np.int64)
    for row, s in zip(patterns, sequences):
        row[width - len(s):] = s
    lengths, low, _ = index.matches(patterns)
    shift = _aligned(sizes, width - window + 1)
    # Columns of the windows, shifted so that every passage's first is column 0.
    columns = (width - sizes)[:, None] + np.arange(width - window + 1)
    columns = np.minimum(columns, width - 1)
    rows = np.arange(len(sequences))[:, None]
    found = (lengths[rows, columns] >= window) & (least[low[rows, columns]] < first[:, None] + shift)
    return found & (shift < (sizes - window + 1)[:, None])


def _aligned(sizes, width):
    return np.broadcast_to(np.arange(width), (len(sizes), width))


_RANGE = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("version", T.LongType()),
    T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType()),
])


def _ranges(docs, versions, low, high):
    return pa.RecordBatch.from_arrays([
        pa.array(docs), pa.array(versions), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))
    ], names=_RANGE.names)


def _search(window: int):
    """Task over passages sorted by key, words, document and start; gives the words that go."""
    def joined(parts):
        return [np.concatenate([p[i] for p in parts]) if i else [w for p in parts for w in p[0]] for i in range(6)]

    def indexed(parts):
        words, key, doc, version, start, _ = joined(parts)
        found = earlier_windows(words, doc, start, window)
        padded = np.pad(found, ((0, 0), (1, 1))).astype(np.int8)
        step = np.diff(padded, axis=1)
        row, low = np.nonzero(step == 1)
        _, high = np.nonzero(step == -1)
        return _ranges(doc[row], version[row], start[row] + low, start[row] + high + window - 1)

    def work(batches):
        last, ready, size, open_ = None, [], 0, []  # open_: distinct passages of the gram not ended yet
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch["words"]
            key, doc, version, start, n = (
                batch[c].to_numpy(zero_copy_only=False) for c in ("key", "doc", "version", "start", "n")
            )
            same = np.zeros(len(key), dtype=bool)
            same[1:] = (key[1:] == key[:-1]) & pc.equal(held[1:], held[:-1]).to_numpy(zero_copy_only=False)
            same[0] = last is not None and last[0] == key[0] and last[1] == held[0].as_py()
            first = np.flatnonzero(~same)
            # The first row with the same words; -1 stands for that of the batch before.
            lead = np.maximum.accumulate(np.where(same, -1, np.arange(len(key))))
            lead_doc = np.where(lead >= 0, doc[lead], last[2] if last else 0)
            lead_start = np.where(lead >= 0, start[lead], last[3] if last else 0)
            again = same & ((doc != lead_doc) | (start != lead_start))
            if again.any():
                yield _ranges(doc[again], version[again], start[again], start[again] + n[again] + window - 1)
            last = key[-1], held[-1].as_py(), lead_doc[-1], lead_start[-1]
            if not len(first):
                continue
            part = held.take(pa.array(first)).to_pylist(), key[first], doc[first], version[first], start[first], n[first]
            parts = joined([*open_, part])
            keys = parts[1]
            alone = np.ones(len(keys), dtype=bool)
            alone[1:] &= keys[1:] != keys[:-1]
            alone[:-1] &= keys[1:] != keys[:-1]
            ended = keys != key[-1]
            use = np.flatnonzero(ended & ~alone)
            if len(use):
                ready.append([[parts[0][i] for i in use], *[p[use] for p in parts[1:]]])
                size += len(use)
            rest = np.flatnonzero(~ended)
            open_ = [[[parts[0][i] for i in rest], *[p[rest] for p in parts[1:]]]]
            if size >= PER_INDEX:
                yield indexed(ready)
                ready, size = [], 0
        if open_ and len(open_[0][0]) > 1:
            ready.extend(open_)
        if ready:
            yield indexed(ready)

    return work


def _apply(window: int, gram: int, hot: np.ndarray, known: dict):
    """Task that takes the words in `ranges`, and hot windows that are not the first, out of texts."""
    def spans(gone):
        edge = np.diff(np.pad(gone, 1).astype(np.int8))
        return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))

    def work(batches):
        for batch in batches:
            out, done = [], 0
            for low, high, data, bounds in _chunks(batch):
                raw, gone = data.tobytes(), {}
                if known:
                    cut = Cut(data, bounds, window, gram)
                    for a, i, words in zip(*_hot_windows(cut, hot)):
                        place, start = known.get(words), int(a - cut.begins[i])
                        if place and place != (int(doc_of(batch, low + int(i))), start):
                            gone.setdefault(int(i), []).append((start, start + window))
                for i, ranges in enumerate(batch["ranges"].slice(low, high - low)):
                    words = raw[bounds[i]:bounds[i + 1]].split()
                    cuts = gone.get(i, []) + [(r["low"], r["high"]) for r in ranges.as_py() or ()]
                    if not cuts:
                        out.append((len(words), 0, b" ".join(words).decode(), []))
                        continue
                    flags = np.zeros(len(words), dtype=bool)
                    for a, b in cuts:
                        flags[a:b] = True
                    kept = b" ".join([w for w, g in zip(words, flags.tolist()) if not g])
                    out.append((len(words), int(flags.sum()), kept.decode(), spans(flags)))
                yield _results(batch, done, out)
                out, done = [], high

    return work


def doc_of(batch, row):
    return batch["doc"][row].as_py()


def _results(batch, low, out):
    n_words, n_removed, kept, spans = zip(*out)
    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
    return pa.RecordBatch.from_arrays([
        batch["key"].slice(low, len(out)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
        pa.array(kept, pa.string()), pa.array([[{"low": a, "high": b} for a, b in s] for s in spans], kind),
    ], names=["key", "n_words", "n_removed", "kept", "spans"])


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
    per_task: int = PER_TASK, hot_least: int = HOT_LEAST,
) -> DataFrame:
    """key, n_words, n_removed, kept, spans: each text without passages that stand earlier.

    Words are runs of anything but ASCII white space.  A word goes if a window of
    `window` words covers it whose words also start earlier: in a document with a smaller
    key (a whole number; null counts as the smallest) or earlier in the same one.  Rows
    with equal keys are versions of one document, so equal places in them do not count
    as earlier and a repeated row loses nothing to its twin.  Null and empty texts have
    no words; texts below the window's length stay whole.  `kept` is the remaining words
    joined by one space, `spans` the removed word ranges.  Extra columns are ignored.

    A gram with very many passages (more than `hot_least` and 1/100,000 of all) is cut
    to single windows with keys of their own.  Windows that are as frequent are at most
    100,000; their first places are broadcast and they need no shuffle.  So a shard's
    largest group is bounded by that share.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"),
        F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("doc"), F.xxhash64(text).alias("version"),
    )
    counts = _counts(keyed, window, gram)
    rows = counts.where(F.col("key").isNull() | (F.col("n") > hot_least)).orderBy(F.desc("n")).limit(HOT_SHARE + 1).collect()
    total = max([r["n"] for r in rows if r["key"] is None], default=0)
    bound = max(hot_least, total // HOT_SHARE)
    hot = np.array([r["key"] for r in rows if r["key"] is not None and r["n"] > bound], dtype=np.int64).view(np.uint64)
    known = _first_places(keyed, window, gram, hot, bound) if len(hot) else {}
    tasks = max(partitions(spark), total // per_task + 1)

    # Only where passages start is shuffled at first; text follows for those that share their gram.
    shared = stage(
        _places(keyed, window, gram, hot).repartition(tasks, "key").sortWithinPartitions("key")
        .mapInArrow(_shared, T.StructType(_PLACE.fields[1:])),
        "shared",
    )
    forget_shuffles(spark)
    starts = shared.groupBy("doc", "version").agg(F.collect_set("start").alias("starts"))
    found = stage(
        _passages(keyed.join(starts, ["doc", "version"], "left"), window, gram, hot, known)
        .repartition(tasks, "key").sortWithinPartitions("key", "words", "doc", "start")
        .mapInArrow(_search(window), _RANGE),
        "ranges",
    )
    release(shared)
    forget_shuffles(spark)
    ranges = found.groupBy("doc", "version").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    out = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())]))),
    ])
    return (
        keyed.join(ranges, ["doc", "version"], "left").select("key", "doc", "text", "ranges")
        .mapInArrow(_apply(window, gram, hot, known), out).withColumnRenamed("key", key)
    )


def oracle_sql(window: int = WINDOW) -> str:
    """DuckDB SQL: every window written out, with the first place of each."""
    return rf"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
),
windows AS (
  SELECT doc_id, s, array_to_string(words[s:s + {window - 1}], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {window} + 2)) AS s FROM docs WHERE len(words) >= {window})
),
firsts AS (SELECT w, min({{'d': doc_id, 's': s}}) AS f FROM windows GROUP BY w HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + {window})) AS i
  FROM windows JOIN firsts USING (w) WHERE {{'d': doc_id, 's': s}} > f
),
listed AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN words ELSE
         list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(g, i)), lambda i: words[i]) END, ' '), '')) AS kept_sha256
FROM docs d LEFT JOIN listed l ON d.doc_id = l.doc_id
"""
