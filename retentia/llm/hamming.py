"""Exact top-k by Hamming distance: incremental multi-index hashing (DataFrame only)."""

from math import ceil, comb

from pyspark.sql import Column, DataFrame, Window, functions as F

from retentia.llm.common import partitions
from retentia.sources.staging import stage

MOST = 32  # bits per segment at most
K = 10
SAMPLE = 256  # codes that give every query a first bound
HOT_SHARE = 1000  # a segment value of more than 1/1000 of all postings is dealt over the tasks


def code_length(vectors: DataFrame, vector="embedding") -> int:
    """Components of the longest vector, 1 at least."""
    return max(1, vectors.agg(F.max(F.size(vector))).first()[0] or 1)


def _kth_distance(bits: int, codes: int, k: int) -> int:
    """Distance within which `codes` codes of independent bits are expected to hold `k`."""
    within = 0
    for distance in range(bits + 1):
        within += comb(bits, distance)
        if codes * within >= k << bits:
            break
    return distance


def _widths(bits: int, count: int) -> list:
    return [bits // count + (i < bits % count) for i in range(count)]


def search_work(bits: int, count: int, codes: int, reach: int) -> float:
    """Values probed and codes met by a search up to distance `reach` with `count` segments.

    Segment i is probed at radius r if count * r + i is not above `reach`; a probed value
    of w bits meets codes / 2^w codes if bits are independent, which is the dearest case.
    """
    wide = bits % count
    work = 0.0
    for width, start, segments in ((bits // count + 1, 0, wide), (bits // count, wide, count - wide)):
        for radius in range(min(width, reach // count) + 1):
            probed = min(max(reach - count * radius + 1 - start, 0), segments)
            work += probed * comb(width, radius) * (1 + codes / 2 ** width)
    return work


def segment_widths(bits: int, codes: int, k: int = K) -> list:
    """Widths of the segments with which a search for `k` codes among `codes` has the least work.

    Few wide segments mean more values to probe, many narrow ones more codes per value;
    the number of segments falls as the index grows.
    """
    reach = _kth_distance(bits, codes, k + 1)
    counts = range(max(1, ceil(bits / MOST)), bits + 1)
    return _widths(bits, min(counts, key=lambda count: search_work(bits, count, codes, reach)))


def sign_codes(vectors: DataFrame, widths: list, key="vec_id", vector="embedding") -> DataFrame:
    """(id, code): bit i is 1 if component i is above 0, in segments of the given widths.

    Missing, null and NaN components are 0 bits.
    """
    def bit(i, place):
        value = F.try_element_at(F.col(vector), F.lit(i + 1))
        return F.when((value > 0) & ~F.isnan(value), F.lit(1 << place)).otherwise(F.lit(0)).cast("long")

    starts = [sum(widths[:i]) for i in range(len(widths))]
    code = F.array(*[
        sum((bit(start + i, i) for i in range(1, width)), bit(start, 0)) for start, width in zip(starts, widths)
    ])
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).alias("id"), code.alias("code")
    )


def _gaps(a: Column, b: Column, segments: int) -> list[Column]:
    return [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(segments)]


def _numbers(values) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _masks(width: int, radius: int) -> Column:
    """All values of `width` bits with `radius` of them set, as (low half, high half) pairs of arrays.

    Every number of a pair's `low` goes with every number of its `high`.
    """
    low = width // 2
    high = width - low
    return F.array(*[
        F.struct(
            _numbers(v for v in range(1 << low) if v.bit_count() == own).alias("low"),
            _numbers(v << low for v in range(1 << high) if v.bit_count() == radius - own).alias("high"),
        )
        for own in range(max(0, radius - high), min(low, radius) + 1)
    ])


def _by_segment(widths: list, radius: int) -> Column:
    """`_masks` of the width of the segment `seg`; widths differ by one at most."""
    wide, narrow = max(widths), min(widths)
    return F.when(F.col("seg") < widths.count(wide), _masks(wide, radius)).otherwise(
        _masks(narrow, radius) if radius <= narrow else F.slice(_masks(narrow, narrow), 1, 0)
    )


def _first_ids(codes: DataFrame, n: int) -> DataFrame:
    """Per distinct code its `n` smallest ids; no other id of it can be in a top n.

    The limit is applied inside each task before the shuffle, so a code shared by
    most rows sends n rows per task.
    """
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    return (
        codes.withColumn("nth", nth).where(F.col("nth") <= n)
        .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )


def _dealt(postings: DataFrame, salts: int):
    """Postings with a `salt`, and a function that gives probes theirs.

    Postings of a hot segment value, of which there are fewer than HOT_SHARE, are dealt
    out by their code; a probe of it goes to all salts.
    """
    total = postings.count()
    hot = stage(
        postings.groupBy("seg", "value").count().where(F.col("count") * F.lit(HOT_SHARE) > total)
        .select("seg", "value", F.lit(salts).alias("_salts")),
        "hot-values",
    )
    where = F.pmod(F.xxhash64("code"), F.coalesce("_salts", F.lit(1)))
    postings = stage(
        postings.join(F.broadcast(hot), ["seg", "value"], "left").withColumn("salt", where.cast("int")).drop("_salts"),
        "postings",
    )

    def spread(probes):
        every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
        return probes.join(F.broadcast(hot), ["seg", "value"], "left").withColumn("salt", F.explode(every)).drop("_salts")

    return postings, spread


def top_k(index: DataFrame, queries: DataFrame, widths: list, k: int = K) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest other ids, ties by id.

    `index` and `queries` have `id` and `code` (see `sign_codes`), both with segments of
    `widths`, in all m of them.  Round s probes, for every unfinished query and segment, the values
    that differ in exactly s bits; a code not met by then differs in more than s
    bits in each segment, so all codes nearer than m (s + 1) are known.  A query is
    finished when its k-th verified distance (counting one more for itself) is
    below that.  After s = the largest width everything has been met.  Postings of
    values that very many codes share are dealt over the tasks.  A fixed sample of codes
    gives each query a first upper bound on that distance, and only codes within
    the current bound leave the join.

    Repeated codes are indexed once, with the ids that can still matter, and equal
    queries are searched once.  With fewer than k other ids all are returned.
    """
    m, bits = len(widths), sum(widths)
    need = k + 1
    known = stage(_first_ids(index, need), "codes")
    postings, spread = _dealt(
        known.select(F.posexplode("code").alias("seg", "value"), "code", "ids"), partitions(index.sparkSession)
    )
    sample = known.orderBy(F.xxhash64("code"), "code").limit(SAMPLE).agg(
        F.collect_list(F.struct("code", F.size("ids").alias("n")))
    ).scalar()
    # Every sampled code stands for one id at least.
    gaps = F.sort_array(F.transform("_sample", lambda x: sum(_gaps(F.col("q"), x["code"], m)[1:], _gaps(F.col("q"), x["code"], m)[0])))
    open_ = stage(
        queries.select(F.col("code").alias("q")).distinct().withColumn("_sample", sample)
        .select("q", F.coalesce(F.get(gaps, F.lit(need - 1)), F.lit(bits)).alias("bound"),
                F.array().cast("array<struct<d:int,id:bigint>>").alias("best")),
        "open",
    )
    finished = []
    for radius in range(max(widths) + 1):
        # With segments 0..j at this radius and the others one below, all codes up to
        # distance m * radius + j are known: more than up to the bound is not needed.
        probes = open_.select("q", "bound", F.posexplode("q").alias("seg", "own")).where(
            F.col("seg") <= F.col("bound") - m * radius
        ).select("q", "bound", "seg", "own", F.explode(_by_segment(widths, radius)).alias("mask")).select(
            "q", "bound", "seg", "own", F.explode("mask.low").alias("low"), "mask.high"
        ).select("q", "bound", "seg", F.col("own").bitwiseXOR(F.col("low")).alias("own"), F.explode("high").alias("high"))
        probes = probes.select("q", "bound", "seg", F.col("own").bitwiseXOR(F.col("high")).alias("value"))
        near = _gaps(F.col("p.q"), F.col("x.code"), m)
        distance = sum(near[1:], near[0])
        # A code is taken once: in the first segment among those nearest to the query.
        first = [F.when(F.col("p.seg") > i, near[i] > radius).otherwise(near[i] >= radius) for i in range(m)]
        accept = distance <= F.col("p.bound")
        for condition in first:
            accept = accept & condition
        # Probes outnumber their estimate, so they must not be broadcast.
        met = spread(probes).hint("merge").alias("p").join(
            postings.alias("x"),
            (F.col("p.seg") == F.col("x.seg")) & (F.col("p.value") == F.col("x.value"))
            & (F.col("p.salt") == F.col("x.salt")) & accept,
        ).select(F.col("p.q").alias("q"), distance.alias("d"), "x.ids")
        # The nearest `need` codes of a query hold its nearest `need` ids; limited per task first.
        order = Window.partitionBy("q").orderBy("d", F.col("ids")[0])
        found = (
            met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= need)
            .select("q", F.explode(F.transform("ids", lambda i: F.struct(
                F.col("d").cast("int").alias("d"), i.cast("bigint").alias("id")))).alias("hit"))
            .groupBy("q").agg(F.collect_list("hit").alias("hits"))
        )
        best = F.slice(F.array_sort(F.concat("best", F.coalesce("hits", F.array().cast(
            "array<struct<d:int,id:bigint>>")))), 1, need)
        state = stage(
            open_.join(found, "q", "left").withColumn("best", best).drop("hits")
            .withColumn("kth", F.get("best", F.lit(need - 1))["d"])
            .withColumn("bound", F.least("bound", F.coalesce("kth", "bound")))
            .withColumn("done", F.coalesce(F.col("kth") < m * (radius + 1), F.lit(radius == max(widths)))),
            "searched",
        )
        finished.append(state.where("done").select("q", "best"))
        open_ = state.where(~F.col("done")).select("q", "bound", "best")
        if open_.limit(1).count() == 0:
            break
    answers = finished[0]
    for more in finished[1:]:
        answers = answers.unionByName(more)
    others = F.slice(F.filter("best", lambda h: h["id"] != F.col("id")), 1, k)
    return (
        queries.join(answers, F.col("code") == F.col("q"))
        .select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "hit"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), "hit.id", F.col("hit.d").alias("distance"))
    )


def oracle_sql(k: int = K) -> str:
    """DuckDB SQL: every query against every code, for small tables."""
    return f"""
WITH codes AS (
  SELECT vec_id, list_transform(range(1, bits + 1), lambda i: CASE WHEN embedding[i] > 0 AND NOT isnan(embedding[i]) THEN 1 ELSE 0 END) AS c
  FROM embeddings, (SELECT max(len(embedding)) AS bits FROM embeddings) WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
         list_sum(list_transform(range(1, len(q.c) + 1), lambda i: CASE WHEN q.c[i] <> x.c[i] THEN 1 ELSE 0 END)) AS distance
  FROM codes q JOIN codes x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM ranked WHERE rank <= {k}
"""
