"""Mixing sources to target weights by systematic sampling (DataFrame only)."""

from pyspark.sql import DataFrame, functions as F

from retentia.llm.common import WORD, attach, running_sums
from retentia.sources.staging import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix per word of the input
CAP = 2  # times a source's words at most
SEED = 20


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """Per source: `_source`, `source_index`, `source_size`, `target`.

    `sizes` has `_source` and `size`.  Sources are numbered by code point, null
    last, and weigh `weights` in turn.  They share `share` times all words in
    proportion to their weights; a target stops at `cap` times its source's words
    and the rest is shared anew.  That settles where every source not stopped
    gets one level times its weight: with sources ordered by cap per weight, the
    level follows from two running sums at the first source it does not stop.
    """
    sources = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    numbered = running_sums(
        sources.withColumn("one", F.lit(1)), [F.col("_source").asc_nulls_last()], {"nth": "one"}
    )
    weigh = F.array(*map(F.lit, weights))
    weighed = stage(numbered.select(
        "_source", "source_size", (F.col("nth") - 1).alias("source_index"),
        F.get(weigh, ((F.col("nth") - 1) % len(weights)).cast("int")).cast("long").alias("weight"),
        (F.col("source_size") * cap).alias("most"),
    ), "weighed")
    per_weight = F.col("most") / F.col("weight")
    ordered = running_sums(
        weighed.withColumn("per_weight", per_weight), ["per_weight", "source_index"],
        {"most_upto": "most", "weight_upto": "weight"},
    )
    totals = weighed.agg(
        F.struct(F.sum("source_size").alias("words"), F.sum("weight").alias("weight"))
    ).scalar()
    level = (
        (F.col("_t.words") * share - (F.col("most_upto") - F.col("most")))
        / (F.col("_t.weight") - (F.col("weight_upto") - F.col("weight")))
    )
    first = (
        ordered.withColumn("_t", totals).withColumn("level", level)
        .where(F.col("level") <= F.col("per_weight"))
        .agg(F.min_by("level", F.struct("per_weight", "source_index")))
        .scalar()
    )
    return weighed.select(
        "_source", "source_index", "source_size",
        # Without a level every source is stopped, as a share above the cap would have it.
        F.least(F.col("most").cast("double"), F.coalesce(first * F.col("weight"), F.col("most").cast("double")))
        .alias("target"),
    )


def sample_copies(
    docs: DataFrame, key="doc_id", text="text", source="source",
    weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED,
) -> DataFrame:
    """Per row of `docs`: key, source, size, source_size, target, copies, taken.

    A document expects target / source_size copies.  Within its source, documents
    stand in order of size; expected copies are summed up along that order, one
    random offset per source is added, and a document is emitted once per whole
    number its share of the sum passes.  In this order each stretch of sizes is
    drawn at the same rate, so the words taken stay within about one document of
    the target.  With cap 2 no document is taken more than twice.

    The result depends on the rows and the seed only, so reruns agree; rows equal
    in key, source and size are interchangeable.  A null text has size 0 and is
    taken 0 words; a null source is a source of its own; without rows the result
    is empty.  Columns of `docs` other than the three named are not read.
    """
    sizes = stage(docs.select(
        F.col(key).alias("_key"), F.col(source).alias("_source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_name"),
    ), "sizes")
    targets = stage(
        source_targets(sizes, weights, share, cap)
        .withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")))
        .drop("_source"),
        "targets",
    )
    known = attach(sizes, targets, "_name").withColumn("one", F.lit(1))
    placed = running_sums(
        known, ["size", F.xxhash64(F.lit(seed), F.col("_key")), "_key"],
        {"nth": "one"}, within="source_index",
    )
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("_name")), F.lit(2**52)) / F.lit(float(2**52))
    copies = (
        F.floor(F.col("_offset") + F.col("nth") * F.col("_each"))
        - F.floor(F.col("_offset") + (F.col("nth") - 1) * F.col("_each"))
    )
    return (
        placed.withColumns({"_each": each, "_offset": offset}).withColumn("copies", copies)
        .select(
            F.col("_key").alias(key), F.col("_source").alias(source), "size", "source_size",
            "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, key="doc_id", text="text", source="source", **options):
    """The rows of `docs`, each as often as `sample_copies` takes it.

    Copies are found on narrow rows and joined to the texts once.  Rows that agree
    in key, source and size are numbered by hashes of their text and of the whole row, and each
    takes the copies of one of them; so reruns agree however the rows are dealt.
    """
    found = sample_copies(docs, key, text, source, **options)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")

    def unit(words):
        return F.struct(F.col(key).alias("k"), F.col(source).alias("s"), words.alias("n"))

    per_unit = found.groupBy(unit(F.col("size")).alias("_unit")).agg(
        F.sort_array(F.collect_list("copies")).alias("_copies")
    )
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), unit(size).alias("unit"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]).alias("r"),
    )
    # A struct equals another in null fields too, and join and window deal rows by it alike, so
    # that the texts are shuffled once.
    joined = left.join(per_unit, F.col("unit") == F.col("_unit")).withColumn(
        "_i", F.when(F.size("_copies") == 1, F.lit(0)).otherwise(F.expr(
            "cast(row_number() over (partition by _unit order by h, r) as int) - 1"
        ))
    )
    times = F.sequence(F.lit(1).cast("long"), F.get("_copies", F.col("_i")))
    return (
        joined.where(F.get("_copies", F.col("_i")) > 0)
        .select("_row", F.explode(times).alias("_copy")).select("_row.*")
    )
