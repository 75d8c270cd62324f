"""Language-model scores from the subword lattice.

The probability of a word is the sum, over all ways to cut it into pieces, of the
product of the pieces' probabilities: a forward recursion in log space.  Pieces are
those of a public vocabulary, all single bytes, and frequent training words, which take
part in cuts like any other.  Weights start from the scores the vocabulary stores and
are re-estimated from the pieces' expected counts in all training words, with the
stored scores as the prior.  Every word, met in training or not, is scored by its
cuts.  A text is its words, each with a leading space, and an end symbol; pieces and end
are one distribution, so the probabilities of all texts together do not exceed 1.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from retentia.sources.staging import stage

ROUNDS = 2  # re-estimations
PRIOR = 0.1  # count the stored scores stand for, per piece on average
WORD_SHARE = 10_000  # words with more than 1/WORD_SHARE of all training tokens are pieces ...
WORD_BYTES = 32  # ... if they are no longer than this, which bounds the trie
HOT = 500_000  # words with more than 1/HOT of all training tokens: at most HOT of them
WORD_LIMIT = 1_000_000  # distinct words a task counts before it passes them on
CELLS = 2_000_000  # positions of words scored at a time
CHUNK = 100_000  # rows per output batch


def vocabulary(model_path: str) -> dict:
    """Stored score of each piece that lower-cased text can hold, and of all single bytes.

    Bytes that are no piece of their own stand below the last piece.
    """
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = {}
    for i in range(library.get_piece_size()):
        if library.is_control(i) or library.is_unknown(i) or library.is_byte(i):
            continue
        raw = library.id_to_piece(i).replace("▁", " ").encode()
        if raw == raw.lower() and b" " not in raw[1:]:
            found.setdefault(raw, library.get_score(i))
    last = min(found.values(), default=0.0) - 1
    for value in range(256):
        found.setdefault(bytes([value]), last)
    return found


def initial_weights(stored) -> np.ndarray:
    """Probabilities from stored scores.

    A merge vocabulary stores minus the rank of the merge as a score, which is no log
    probability; a piece of rank r weighs 1 / (r + 2), as words do by rank.
    """
    weight = 1.0 / (2.0 - np.asarray(stored, float))
    return weight / weight.sum()


class Lattice:
    """Trie of the pieces, and sums over all segmentations of words."""

    def __init__(self, pieces: list, scores: np.ndarray):
        self.scores = scores
        nodes, piece_of = [{}], [-1]
        for number, raw in enumerate(pieces):
            at = 0
            for value in raw:
                nxt = nodes[at].get(value)
                if nxt is None:
                    nxt = nodes[at][value] = len(nodes)
                    nodes.append({})
                    piece_of.append(-1)
                at = nxt
            piece_of[at] = number
        self.next = np.zeros((len(nodes), 256), np.int32)  # 0: no such piece
        for at, children in enumerate(nodes):
            for value, nxt in children.items():
                self.next[at, value] = nxt
        self.piece_of = np.array(piece_of, np.int32)

    def batches(self, words: list):
        """Indices of words of one length at a time, and their bytes as columns."""
        lengths = np.array([len(w) + 1 for w in words])
        order = np.argsort(lengths, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(lengths[order]) > 0]) if len(order) else []
        for low, high in zip(heads, [*heads[1:], len(order)]):
            size = int(lengths[order[low]])
            step = max(1, CELLS // size)
            for at in range(low, high, step):
                some = order[at:min(at + step, high)]
                raw = b"".join(b" " + words[i] for i in some)
                yield some, np.frombuffer(raw, np.uint8).reshape(len(some), size).T

    def forward(self, letters: np.ndarray, keep: bool):
        """Log sums up to each position, and the edges used if `keep`."""
        size, n = letters.shape
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0.0
        edges = []
        for start in range(size):
            rows, node = np.arange(n), np.zeros(n, np.int32)
            for stop in range(start + 1, size + 1):
                node = self.next[node, letters[stop - 1, rows]]
                alive = node > 0
                if not alive.all():
                    rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                piece = self.piece_of[node]
                ends = piece >= 0
                if ends.any():
                    r, p = (rows, piece) if ends.all() else (rows[ends], piece[ends])
                    alpha[stop, r] = np.logaddexp(alpha[stop, r], alpha[start, r] + self.scores[p])
                    if keep:
                        edges.append((start, stop, r, p))
        return alpha, edges

    def log_probabilities(self, words: list) -> np.ndarray:
        out = np.zeros(len(words))
        for some, letters in self.batches(words):
            out[some] = self.forward(letters, False)[0][-1]
        return out

    def expected_counts(self, words: list, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each taken `times`."""
        total = np.zeros(len(self.scores))
        for some, letters in self.batches(words):
            alpha, edges = self.forward(letters, True)
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = 0.0
            whole, count = alpha[-1], times[some]
            for start, stop, r, p in reversed(edges):
                through = self.scores[p] + beta[stop, r]
                total += np.bincount(
                    p, count[r] * np.exp(alpha[start, r] + through - whole[r]), len(total)
                )
                beta[start, r] = np.logaddexp(beta[start, r], through)
        return total


# -- counting -------------------------------------------------------------------

def _tokens(text: str | None) -> list:
    """Words of a text, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c): every word of `_text`, and how often rows with `_train` hold it.

    Tasks count words before anything is shuffled, and pass on what they have
    whenever they hold WORD_LIMIT distinct words.
    """
    def count(batches):
        seen = Counter()

        def passed_on():
            found = list(seen.items())
            for low in range(0, len(found), CHUNK):
                some = found[low:low + CHUNK]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in some], pa.binary()), pa.array([c for _, c in some], pa.int64())],
                    names=["word", "c"],
                )
            seen.clear()

        for batch in batches:
            for text, train in zip(batch.column("_text"), batch.column("_train").to_pylist()):
                found = _tokens(text.as_py())
                if train:
                    seen.update(found)
                else:
                    for word in found:
                        seen.setdefault(word, 0)
                if len(seen) > WORD_LIMIT:
                    yield from passed_on()
        yield from passed_on()

    return rows.select("_text", "_train").mapInArrow(count, "word binary, c long").groupBy("word").agg(
        F.sum("c").alias("c")
    )


def frequent_words(counts: DataFrame, tokens: int) -> dict:
    """Share of all tokens of each word, of WORD_BYTES at most, above 1/WORD_SHARE of them."""
    found = counts.where(
        (F.col("c") * F.lit(WORD_SHARE) > F.lit(tokens)) & (F.octet_length("word") <= WORD_BYTES)
    ).toPandas()  # at most WORD_SHARE rows
    return dict(sorted((b" " + bytes(w), c / tokens) for w, c in zip(found["word"], found["c"])))


def piece_scores(spark: SparkSession, counts: DataFrame, pieces: list, start: np.ndarray, texts: int,
                 rounds: int = ROUNDS) -> np.ndarray:
    """Log probability of each piece, and of the end symbol last.

    `start` are the pieces' probabilities at first, and what counts are smoothed by.
    """
    shared = spark.sparkContext.broadcast(pieces)
    prior = PRIOR * len(pieces) * start
    expected = np.zeros(len(pieces))
    scores = np.log(start)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(scores)

        def expect(batches):
            lattice = Lattice(shared.value, sent.value)
            total = np.zeros(len(shared.value))
            for batch in batches:
                total += lattice.expected_counts(
                    batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
                )
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"]
            )

        found = (
            counts.where("c > 0").mapInArrow(expect, "piece int, n double")
            .groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        )
        expected = np.zeros(len(pieces))
        expected[found["piece"]] = found["n"]
        share = expected + prior
        scores = np.log(share / share.sum())
    share = np.r_[expected + prior, texts + PRIOR]
    return np.log(share / share.sum())


# -- scoring --------------------------------------------------------------------

def score_texts(docs: DataFrame, model_path: str, train, key="doc_id", text="text",
                rounds: int = ROUNDS) -> DataFrame:
    """Per row of `docs`: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `train` is a boolean column of `docs`: rows to learn from.  Tokens are words
    and one end per text.  `score` is log10 of the text's probability under the
    lattice; `base_score` that of a smoothed unigram model of whole tokens; both
    learn from the training rows only.  Every word is scored by the sum over its cuts, once.  Frequent
    words, at most HOT, go to the tasks; the others meet their scores by a
    shuffle join on the word and are summed per text.

    A null text counts as empty: one token.  Without training rows all base
    scores are 0 per token and pieces keep their vocabulary scores.  Repeated rows
    and keys are scored row by row, a null key like any other; other columns are
    not read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train")
    )
    counts = stage(word_counts(rows), "words")
    texts = rows.where("_train").count()
    sums = counts.agg(
        F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")
    ).first()
    tokens, kinds = (sums["n"] or 0) + texts, sums["v"] + (1 if texts else 0)
    stored, words = vocabulary(model_path), frequent_words(counts, tokens)
    start = dict(zip(stored, initial_weights(list(stored.values())) * (1 - sum(words.values()) / 2)))
    for word, share in words.items():  # half their tokens go to the word whole at first
        start[word] = start.get(word, 0.0) + share / 2
    pieces = list(start)
    learned = piece_scores(spark, counts, pieces, np.array(list(start.values())), texts, rounds if sums["v"] else 0)
    end_score = float(learned[-1] / np.log(10))
    shared = spark.sparkContext.broadcast((pieces, learned[:-1]))

    def weigh(batches):
        lattice = Lattice(*shared.value)
        for batch in batches:
            found = lattice.log_probabilities(batch.column("word").to_pylist()) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array(found)], names=["word", "c", "lp"]
            )

    whole = tokens + 0.5 * (kinds + 1)
    weighed = stage(
        counts.mapInArrow(weigh, "word binary, c long, lp double")
        .withColumn("base", F.log10((F.col("c") + 0.5) / F.lit(whole))),
        "weighed",
    )
    hot = weighed.where(F.col("c") * F.lit(HOT) > F.lit(tokens)).toPandas()
    known = spark.sparkContext.broadcast(dict(zip(hot["word"].map(bytes), zip(hot["base"], hot["lp"]))))
    end_base = float(np.log10((texts + 0.5) / whole))

    names = ["row", "word", "n", "key", "held_out", "n_tokens", "base", "lp", "n_hot"]
    types = [pa.int64(), pa.binary(), pa.int64(), None, pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def spread(batches):
        """Per text a head row with what the frequent words add, and a row per other word.

        The word of a head row holds a space, so it joins nothing and goes anywhere.
        """
        table = known.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            kinds_ = [t or batch.schema.field("_key").type for t in types]
            out = [[] for _ in names]

            def flushed():
                made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds_)], names=names)
                for column in out:
                    column.clear()
                return made

            for key_, text_, train_ in zip(batch.column("_key").to_pylist(), batch.column("_text"),
                                           batch.column("_train").to_pylist()):
                found = _tokens(text_.as_py())
                base, lp, n_hot, rare = end_base, end_score, 0, []
                for word, n in Counter(found).items():
                    own = table.get(word)
                    if own:
                        base += n * own[0]
                        lp += n * own[1]
                        n_hot += n
                    else:
                        rare.append((word, n))
                row += 1
                size = 1 + len(rare)
                out[0] += [row] * size
                out[1] += [b" %d" % row, *[w for w, _ in rare]]
                out[2] += [0, *[n for _, n in rare]]
                for column, value in zip(out[3:], (key_, not train_, len(found) + 1, base, lp, n_hot)):
                    column.append(value)
                    column += [None] * len(rare)
                if len(out[0]) > CHUNK:
                    yield flushed()
            if out[0]:
                yield flushed()

    key_type = rows.schema["_key"].dataType.simpleString()
    scattered = rows.mapInArrow(
        spread, f"row long, word binary, n long, key {key_type}, held_out boolean, n_tokens long, "
        "base double, lp double, n_hot long",
    ).alias("s")
    tail = weighed.where(F.col("c") * F.lit(HOT) <= F.lit(tokens)).alias("w")
    met = scattered.join(tail, F.col("s.word") == F.col("w.word"), "left")

    def added(own, other):
        return F.sum(F.coalesce(own, F.col("s.n") * other, F.lit(0.0)))

    found = met.groupBy("s.row").agg(
        F.max("s.key").alias("key"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_hot", F.when(F.col("w.c") > 0, F.col("s.n")), F.lit(0))).alias("n_known"),
        added(F.col("s.base"), F.col("w.base")).alias("base_score"),
        added(F.col("s.lp"), F.col("w.lp")).alias("score"),
    )
    return found.select(
        F.col("key").alias(key), "held_out", "n_tokens",
        (F.col("n_known") + F.lit(1 if texts else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
