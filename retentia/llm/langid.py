"""Language identification by compression with per-language dictionaries."""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from retentia.llm.common import free_name

SAMPLE_TEXTS = 32  # training texts per language
SAMPLE_CHARS = 2000  # of each of them
BLOCK = 4096  # bytes compressed at a time
LEVEL = 6
MIN_MARGIN = 0.01  # a smaller saving over the second language is rejected
UNKNOWN = "und"


def dictionaries(labelled: DataFrame, text="text", lang="lang",
                 texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict:
    """Raw dictionary content per language, from a bounded sample of labelled rows.

    All labelled rows are hashed into `texts` buckets per language; the smallest
    hash of each bucket marks the texts to take, of which the first `chars`
    characters are used.  So the sample is the same on every run and bounded by
    the number of languages.  Rows without text or language are not used.
    """
    spark = labelled.sparkSession
    rows = labelled.where(
        F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
    ).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    marks = rows.groupBy("lang", F.pmod("h", F.lit(texts)).alias("bucket")).agg(F.min("h").alias("h"))
    taken = (
        rows.join(F.broadcast(marks.select("lang", "h")), ["lang", "h"])
        .select("lang", "h", F.lower(F.substring("text", 1, chars)).alias("text")).distinct()
        .orderBy("lang", "h").collect()
    )
    content = {}
    for row in taken:
        content.setdefault(row["lang"], []).append(row["text"])
    return {name: "\n".join(parts).encode() for name, parts in sorted(content.items())}


class Classifier:
    """Compressed size of a text under each language's dictionary."""

    def __init__(self, content: dict, level: int = LEVEL):
        import zstandard

        parameters = zstandard.ZstdCompressionParameters.from_level(
            level, dict_size=max([0, *map(len, content.values())]), min_match=3,
            write_checksum=0, write_content_size=0, write_dict_id=0,
        )
        self.names = sorted(content)
        self.compressors = []
        for name in self.names:
            words = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=parameters)
            self.compressors.append(
                zstandard.ZstdCompressor(dict_data=words, compression_params=parameters)
            )

    def sizes(self, text: str) -> list:
        """One total per language.  Blocks are compressed apart, so that a long text
        leans on the dictionary throughout and not on its own beginning."""
        raw = text.lower().encode("utf-8", "replace")
        blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def predict(self, text: str):
        """Language of the smallest size (ties: first name) and what it saves over the next."""
        found = self.sizes(text)
        if not found:
            return UNKNOWN, 0.0
        best = min(range(len(found)), key=lambda i: (found[i], self.names[i]))
        rest = [s for i, s in enumerate(found) if i != best]
        return self.names[best], 1.0 - found[best] / min(rest) if rest else 1.0


def identify(docs: DataFrame, content: dict, text="text", margin: float = MIN_MARGIN,
             names=("lang_pred", "score", "rejected")) -> DataFrame:
    """`docs` with `lang_pred`, `score` and `rejected`, or as `names` (replaced if present).

    `score` is the share of bytes the chosen dictionary saves over the second best,
    0 to 1.  A null text or one without a letter is 'und' with score 0; with no
    learned language every text is.  `rejected` marks 'und' and scores below
    `margin`.  Only the text is looked at; other columns pass through.  No shuffle:
    the dictionaries, bounded per language, go to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    kept = base.columns
    flag = free_name(base, "_letters")
    marked = base.withColumn(flag, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([
        *base.schema.fields,
        *map(T.StructField, names, (T.StringType(), T.DoubleType(), T.BooleanType())),
    ])

    def run(batches):
        classifier = Classifier(shared.value)
        for batch in batches:
            letters = batch.column(flag).to_pylist()
            found = [
                classifier.predict(t.as_py()) if has else (UNKNOWN, 0.0)
                for t, has in zip(batch.column(text), letters)
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept],
                 pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[0] == UNKNOWN or f[1] < margin for f in found], pa.bool_())],
                names=[*kept, *names],
            )

    return marked.mapInArrow(run, schema)


def held_out(key: str, folds: int = 3, fold: int = 1):
    """True for rows whose crc32 of the key as text leaves `fold`; a null key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds == fold
