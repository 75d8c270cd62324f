"""Ranked lexical search: documents grouped by which of an item's terms they hold.

A block of documents is turned into one bitmap per term of an item.  Transposed, the
bitmaps give each document its presence mask; documents with equal masks form a
group.  A group's score cannot exceed what its terms' largest counts in the block
and its shortest document would give, so groups are scored from the highest such
bound downwards, until the bound falls below the k-th best score.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from retentia.llm.common import running_sums
from retentia.sources.staging import stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 50
# Bytes of distinct terms of the items that one pass over the documents serves.
PASS_BYTES = 4 << 20
# Cells (terms of an item times documents) of a block, and its most documents and postings.
CELLS, BLOCK, POSTINGS = 1 << 22, 1 << 16, 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes of a term lie in these ranges; every byte above 0x7F belongs to a letter
# beyond ASCII.  All others become spaces, and A-Z become a-z.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20
    for b in range(256)
)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): each item's distinct terms, over all rows with its key."""
    terms = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(key).alias("item"), F.explode(terms).alias("term")).distinct()


def _passes(terms: DataFrame):
    """Items dealt into passes of PASS_BYTES of terms each, one item at least."""
    per_item = terms.groupBy("item").agg(
        F.collect_list("term").alias("terms"), F.sum(F.octet_length("term") + 16).alias("bytes")
    )
    # A null key cannot be ordered with the others by a join; it goes by a flag.
    keyed = per_item.withColumn("_order", F.coalesce("item", F.lit(0))).withColumn("_null", F.col("item").isNull())
    return stage(
        running_sums(keyed, ["_order", "_null"], {"_upto": "bytes"})
        .select("item", "terms", F.expr(f"(_upto - bytes) div {PASS_BYTES}").alias("pass")),
        "items",
    )


def _index(docs: DataFrame, key: str, text: str, vocabulary: dict) -> DataFrame:
    """(key, n, terms, counts) of every document that has a term; only known terms are listed."""
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
    ])
    kind = pa.int64() if docs.schema[key].dataType == T.LongType() else None

    def work(batches):
        for batch in batches:
            texts, keys = batch["text"], batch["key"]
            for low in range(0, batch.num_rows, 512):
                rows, lengths, terms, counts, ends = [], [], [], [], [0]
                for i in range(low, min(low + 512, batch.num_rows)):
                    raw = texts[i].as_py()
                    found = raw.encode().translate(_TERM_BYTES).split() if raw else []
                    if not found:
                        continue
                    held = Counter(map(vocabulary.get, found))
                    held.pop(None, None)
                    rows.append(i)
                    lengths.append(len(found))
                    terms.extend(held)
                    counts.extend(held.values())
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(rows, pa.int64())).cast(kind or keys.type), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
                ], names=["key", "n", "terms", "counts"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, schema)


def groups_by_mask(present: np.ndarray):
    """Group number of every column of the boolean matrix [term, document], and the groups' first columns."""
    rows = np.packbits(present, axis=0)
    rows = np.vstack([rows, np.zeros((-len(rows) % 8, rows.shape[1]), dtype=np.uint8)])
    words = np.ascontiguousarray(rows.T).view(np.uint64)
    group = np.zeros(len(words), dtype=np.int64)
    for w in range(words.shape[1]):  # refined word by word, so any number of terms will do
        _, part = np.unique(words[:, w], return_inverse=True)
        _, group = np.unique(group * (part.max(initial=0) + 1) + part, return_inverse=True)
    _, first = np.unique(group, return_index=True)
    return group, first


def _score(weights, tf, m):
    """Exact scores of columns: sum over terms of w * ((10^9 tf) div (1000 tf + 20 m))."""
    tf = tf.astype(np.int64)
    return (weights[:, None] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))).sum(axis=0)


def best_in_block(tf: np.ndarray, weights: np.ndarray, m: np.ndarray, keys: np.ndarray, best, k: int):
    """The k best (score, key) of `best` and this block's documents; tf is [term, document].

    `best` is a pair of arrays.  Returned scores are above 0; ties go to smaller keys.
    """
    some = np.flatnonzero(tf.any(axis=0))
    if not len(some):
        return best
    tf, m, keys = tf[:, some], m[some], keys[some]
    group, first = groups_by_mask(tf > 0)
    shortest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(shortest, group, m)
    most = tf.max(axis=1)[:, None]
    bounds = _score(weights, np.where(tf[:, first] > 0, most, 0), shortest)
    order = np.argsort(-bounds, kind="stable")
    members = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[members], np.arange(len(first) + 1))
    sizes = np.diff(starts)[order]
    scores, found = best
    done = 0
    while done < len(order):
        kth = scores[k - 1] if len(scores) >= k else 1
        if bounds[order[done]] < kth:
            break
        # As many groups as it takes to fill the list, twice as many documents each time.
        upto = int(np.searchsorted(np.cumsum(sizes[done:]), max(4 * k, 2 * int(sizes[:done].sum())))) + done + 1
        take = order[done:upto]
        take = take[bounds[take] >= kth]
        at = np.concatenate([members[starts[g]:starts[g + 1]] for g in take])
        new = _score(weights, tf[:, at], m[at])
        scores, found = np.concatenate([scores, new]), np.concatenate([found, keys[at]])
        top = np.lexsort((found, -scores))[:k]
        top = top[scores[top] > 0]
        scores, found = scores[top], found[top]
        done = upto
    return scores, found


def _search(index: DataFrame, items: list, weights: dict, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item number, key, score, task): every task's k best documents per item."""
    wanted = [
        (i, np.array(sorted(t for t in terms if weights.get(t, 0) > 0), dtype=np.int64)) for i, terms in enumerate(items)
    ]
    wanted = [(i, t, np.array([weights[x] for x in t.tolist()], dtype=np.int64)) for i, t in wanted if len(t)]
    longest = max((len(t) for _, t, _ in wanted), default=1)
    block = max(64, min(BLOCK, CELLS // longest))

    def blocks(batches):
        rows, postings, held = 0, 0, []
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                held.append(part)
                rows, postings = rows + part.num_rows, postings + len(part["terms"].flatten())
                if rows >= block or postings >= POSTINGS:
                    yield held
                    rows, postings, held = 0, 0, []
        if held:
            yield held

    def work(batches):
        from pyspark import TaskContext

        best = {}
        for held in blocks(batches):
            keys = np.concatenate([p["key"].to_numpy(zero_copy_only=False) for p in held])
            n = np.concatenate([p["n"].to_numpy(zero_copy_only=False) for p in held])
            sizes = np.concatenate([np.diff(p["terms"].offsets.to_numpy()) for p in held])
            terms = np.concatenate([p["terms"].flatten().to_numpy() for p in held])
            counts = np.concatenate([p["counts"].flatten().to_numpy() for p in held])
            # Lengths count terms of the whole text; 50 n N may pass 64 bits, so Python's integers divide.
            lengths, back = np.unique(n, return_inverse=True)
            m = np.array([50 + (50 * int(x) * n_docs) // n_terms for x in lengths], dtype=np.int64)[back]
            docs = np.repeat(np.arange(len(n)), sizes)
            order = np.argsort(terms, kind="stable")
            terms, docs, counts = terms[order], docs[order], counts[order]
            for i, of, w in wanted:
                lows, highs = np.searchsorted(terms, of), np.searchsorted(terms, of, side="right")
                for low in range(0, len(n), block):  # a block of one long run of rows may be larger
                    high = min(low + block, len(n))
                    tf = np.zeros((len(of), high - low), dtype=np.int32)
                    for row, (a, b) in enumerate(zip(lows, highs)):
                        a, b = a + np.searchsorted(docs[a:b], low), a + np.searchsorted(docs[a:b], high)
                        tf[row, docs[a:b] - low] = counts[a:b]
                    nothing = np.zeros(0, dtype=np.int64), keys[:0]
                    best[i] = best_in_block(tf, w, m[low:high], keys[low:high], best.get(i, nothing), k)
        task = TaskContext.get().partitionId()
        for i, (scores, found) in best.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(found), i, dtype=np.int32)), pa.array(found), pa.array(scores),
                pa.array(np.full(len(found), task, dtype=np.int32)),
            ], names=["i", "key", "score", "task"])

    schema = T.StructType([
        T.StructField("i", T.IntegerType()), index.schema["key"],
        T.StructField("score", T.LongType()), T.StructField("task", T.IntegerType()),
    ])
    return index.where("key IS NOT NULL").mapInArrow(work, schema)


def top_documents(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id",
    text: str = "text", k: int = K,
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0.

    Keys are whole numbers.  Documents without a term count nowhere; one without a key
    counts in the statistics and is not listed.  Repeated rows are documents of their
    own.  Rows of items with equal keys, null ones too, form one item; items without
    terms have no rows.  Extra columns are ignored.  Items are served in passes over the
    documents, as many as their terms need at PASS_BYTES each; only one pass's terms are
    on the driver and in the tasks.
    """
    dealt = _passes(item_terms(items, item_key, text))
    last = dealt.agg(F.max("pass")).first()[0]
    out = []
    for number in range(0 if last is None else last + 1):
        held = dealt.where(F.col("pass") == number).select("item", "terms").collect()
        if not held:  # a single item may fill several passes
            continue
        names = sorted({t for r in held for t in r["terms"]})
        vocabulary = {t.encode(): j for j, t in enumerate(names)}
        index = stage(_index(docs, doc_key, text, vocabulary), "index")
        n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = index.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # one row per term
        weights = {
            r["t"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1))) for r in holding
        }
        ids = [[vocabulary[t.encode()] for t in r["terms"]] for r in held]
        found = _search(index, ids, weights, n_docs, n_terms, k)
        keys = F.array(*[F.lit(r["item"]).cast("long") for r in held])
        out.append(found.select(keys[F.col("i")].alias(item_key), "key", "score", "task", "i"))
    if not out:
        return docs.sparkSession.createDataFrame([], f"{item_key} long, rank int, {doc_key} long, score long")
    hits = out[0]
    for more in out[1:]:
        hits = hits.unionByName(more)
    # Tasks are merged in groups first, so no task meets the lists of all others at once.
    order = [F.desc("score"), F.col("key")]
    some = Window.partitionBy(item_key, F.col("task") % 64).orderBy(*order)
    part = hits.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    whole = Window.partitionBy(item_key).orderBy(*order)
    return (
        part.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
        .select(item_key, "rank", F.col("key").alias(doc_key), "score")
    )


def oracle_sql(k: int = K) -> str:
    """DuckDB SQL: every item against every document that shares a term."""
    terms = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
    return rf"""
WITH occurrences AS (SELECT doc_id, unnest({terms}) AS t FROM documents),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM occurrences GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM occurrences GROUP BY ALL),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM tfs CROSS JOIN totals GROUP BY t, docs
),
wanted AS (SELECT DISTINCT item_id, unnest({terms}) AS t FROM benchmark),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM wanted JOIN tfs USING (t) JOIN weights USING (t) JOIN lengths USING (doc_id) CROSS JOIN totals
  GROUP BY ALL
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}
"""
