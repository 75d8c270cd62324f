"""Sharding by Hilbert-curve order of several metadata dimensions (DataFrame only)."""

from pyspark.sql import Column, DataFrame, functions as F

from retentia.llm.common import attach, running_sums
from retentia.sources.staging import stage

BITS = 5  # 32 steps per dimension
SHARDS = 40
OVERHEAD = 16  # bytes of a row besides its text


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of the point with whole coordinates below 2^bits.

    Skilling's transform: from the highest bit down, each axis either inverts the
    lower bits of the first axis or swaps them with its own; the Gray code of the
    result is then read bit by bit across the axes.
    """
    n = len(axes)
    steps = F.array(*[
        F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i"))
        for b in range(bits - 1, 0, -1) for i in range(n)
    ]).cast("array<struct<q:int,i:int>>")

    def turn(x, step):
        low = step["q"] - 1
        first, own = F.get(x, F.lit(0)), F.get(x, step["i"])
        inverts = own.bitwiseAND(step["q"]) != 0
        change = F.when(inverts, low).otherwise(first.bitwiseXOR(own).bitwiseAND(low))
        return F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(change)).when(
            (k == step["i"]) & ~inverts, v.bitwiseXOR(change)).otherwise(v))

    turned = F.aggregate(F.array(*[a.cast("int") for a in axes]), F.array().cast("array<int>"),
                         lambda acc, v: F.concat(acc, F.array(v)))
    turned = F.aggregate(steps, turned, turn)
    gray = F.aggregate(
        turned, F.array().cast("array<int>"),
        lambda acc, v: F.concat(acc, F.array(
            F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)).bitwiseXOR(v)
        )),
    )
    highs = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]).cast("array<int>")

    def straighten(x):
        last = F.get(x, F.lit(n - 1))
        flip = F.aggregate(highs, F.lit(0), lambda t, q: F.when(
            last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(x, lambda v: v.bitwiseXOR(flip))

    order = F.array(*[
        F.struct(F.lit(b).alias("b"), F.lit(i).alias("i"))
        for b in range(bits - 1, -1, -1) for i in range(n)
    ])
    # An array of one, so that the long expression is evaluated once per row.
    return F.get(F.transform(F.array(gray), lambda g: F.get(F.transform(
        F.array(straighten(g)),
        lambda x: F.aggregate(order, F.lit(0).cast("long"), lambda acc, o: acc * 2 + F.call_function(
            "shiftright", F.get(x, o["i"]), o["b"]).bitwiseAND(1)),
    ), F.lit(0))), F.lit(0))


def share_steps(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Per distinct value of `column` (nulls first): `_step`, of about equal row counts.

    A value's step is where its first row stands among all rows in value order, so
    equal values share a step and steps rise with the values.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    placed = running_sums(counts, [F.col(column).asc_nulls_first()], {"_upto": "_n"})
    total = df.agg(F.count("*")).scalar()
    step = F.floor((F.col("_upto") - F.col("_n")) * F.lit(1 << bits) / total).cast("int")
    return placed.select(column, step.alias(f"{column}_step"))


def hilbert_shards(
    docs: DataFrame, shards: int = SHARDS, key="doc_id", text="text",
    labels=("source", "lang"), bits: int = BITS,
) -> DataFrame:
    """Per row of `docs`: key, size, text_crc32, curve, position, shard, slot.

    Dimensions are the labels, the size (steps of equal row counts) and the key
    (steps of equal width).  Rows are sorted along the curve through them and cut
    into runs whose row counts differ by one at most, so a shard covers narrow
    ranges of every dimension and readers can skip files by their statistics.
    Within a curve cell equal texts stand together.

    A null or empty text has the bare row overhead as size and crc 0; null labels
    form the first step, a null key counts as the smallest; equal rows take
    neighbouring places; without rows the result is empty.  Other columns are
    not read.
    """
    names = [f"_label{i}" for i in range(len(labels))]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stage(docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("_size"),
        F.crc32(body).alias("_crc"),
        *[F.coalesce(F.concat(F.lit("="), F.col(l).cast("string")), F.lit("")).alias(n)
          for l, n in zip(labels, names)],
    ), "meta")
    stepped = rows
    for name in [*names, "_size"]:
        stepped = stage(
            attach(stepped, stage(share_steps(rows, name, bits), "steps"), name), "stepped"
        )
    bounds = rows.agg(F.struct(F.min("_key").alias("low"), F.max("_key").alias("high"))).scalar()
    exact = "decimal(38,0)"  # keys at both ends of the long range are further apart than a long holds
    low = F.col("_b.low").cast(exact)
    wide = (F.col("_b.high").cast(exact) - low + 1).cast("double")
    key_step = F.coalesce(
        F.floor((F.col("_key").cast(exact) - low).cast("double") * F.lit(1 << bits) / wide).cast("int"), F.lit(0)
    )
    axes = [F.col(f"{n}_step") for n in [*names, "_size"]] + [F.col("_key_step")]
    curved = (
        stepped.withColumn("_b", bounds).withColumn("_key_step", F.least(key_step, F.lit((1 << bits) - 1)))
        .select("_key", "_size", "_crc", hilbert_index(axes, bits).alias("curve"), F.lit(1).alias("one"))
    )
    placed = running_sums(curved, ["curve", "_crc", "_key"], {"nth": "one"})
    position = F.col("nth") - 1
    shard = F.expr(f"(nth - 1) * {shards} div _total")
    first = F.expr(f"(_shard * _total + {shards - 1}) div {shards}")
    return (
        placed.withColumn("_total", rows.agg(F.count("*")).scalar())
        .withColumn("_shard", shard)
        .select(
            F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
            "curve", position.alias("position"), F.col("_shard").cast("int").alias("shard"),
            (position - first).alias("slot"),
        )
    )


def write_shards(docs: DataFrame, placed: DataFrame, folder: str, key="doc_id") -> None:
    """Write `docs` as one directory per shard, rows in slot order.

    `key` must identify rows.  Each shard is a run of positions, so writing needs
    one range exchange and no exchange by shard number alone.
    """
    places = placed.select(F.col(key).alias("_k"), "position", "shard")
    (
        docs.join(places, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
        .repartitionByRange("position").sortWithinPartitions("shard", "position")
        .drop("position").write.partitionBy("shard").parquet(folder)
    )
