"""SentencePiece encoding and decoding by vectorised merge rounds.

A byte-pair model merges, again and again, the adjacent pair whose merged piece
has the best score, the leftmost first among equals.  No piece has a space after
a non-space, so no pair across such a place ever merges and each run 'spaces +
non-spaces' is encoded on its own.  The distinct runs of a batch lie in one flat
array of symbols; a round finds each run's best pair, merges its occurrences
from the left, and closes the gaps, until no pair is left.
"""

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, types as T

SPACE = "▁"
NONE = np.iinfo(np.int32).max
POOL_SYMBOLS = 4_000_000  # a task forgets its encoded runs beyond this
BATCH_BYTES = 4_000_000  # text per output batch
LONG_RUN = 512  # symbols; longer runs are merged through buckets of ranks, with the same result


class PieceModel:
    """Vocabulary of a sentencepiece BPE model as lookup arrays.

    Symbols are piece ids; a character without a piece is the number of pieces
    plus its code point.  Only models that keep their input as it is, apart from
    one leading space, are accepted.
    """

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = library.get_piece_size()
        kept = library.normalize(" a\t b  Éﬁ ")
        if kept != f"{SPACE}{SPACE}a\t{SPACE}b{SPACE}{SPACE}Éﬁ{SPACE}":
            raise ValueError("the model normalises its input")
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in range(n)]
        self.texts = [
            "" if library.is_control(i) else library.id_to_piece(i).replace(SPACE, " ") for i in range(n)
        ]
        if any(library.is_unused(i) for i in range(n)):
            raise ValueError("the model has unused pieces")
        self.end_id = library.eos_id()
        self.byte_ids = np.full(256, library.unk_id(), np.int32)
        self.byte_of = {}
        for i in range(n):
            if library.is_byte(i):
                value = int(library.id_to_piece(i)[1:-1], 16)
                self.byte_ids[value] = i
                self.byte_of[i] = value
        symbol = {self.texts[i]: i for i in range(n) if not special[i]}
        best_first = sorted({-library.get_score(i) for t, i in symbol.items() if len(t) > 1})
        place = {s: k for k, s in enumerate(best_first)}
        rank = {t: place[-library.get_score(i)] for t, i in symbol.items() if len(t) > 1}
        self.whole_text = any(re.search("[^ ] ", t) for t in symbol)

        def of(text):
            return symbol.get(text, n + ord(text) if len(text) == 1 else None)

        pairs = {}
        for text, r in rank.items():
            for cut in range(1, len(text)):
                left, right = of(text[:cut]), of(text[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (symbol[text], r)
        self.base = n + 0x110000
        keys = np.array([l * self.base + r for l, r in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.merged = np.array([m for m, _ in pairs.values()], np.int64)[order]
        self.ranks = np.array([r for _, r in pairs.values()], np.int32)[order]
        # A merge may open a pair of the same or a better rank; then a round takes
        # only the leftmost occurrence, as the next merge may be another one.
        self.one_by_one = np.zeros(len(best_first) + 1, bool)
        opens = {}
        for (left, right), (_, r) in pairs.items():
            for part in (left, right):
                opens[part] = min(opens.get(part, NONE), r)
        for text, r in rank.items():
            if opens.get(symbol[text], NONE) <= r:
                self.one_by_one[r] = True
        self.of_char = np.arange(n, n + 0x3000, dtype=np.int64)
        self.rare_char = {}
        for text, i in symbol.items():
            if len(text) == 1:
                if ord(text) < 0x3000:
                    self.of_char[ord(text)] = i
                else:
                    self.rare_char[ord(text)] = i

    def symbols(self, runs: list):
        """Flat symbols of the characters of all runs, and the run of each."""
        codes = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).astype(np.int64)
        low = codes < 0x3000
        flat = codes + self.size
        flat[low] = self.of_char[codes[low]]
        for at in np.flatnonzero(~low):
            flat[at] = self.rare_char.get(int(codes[at]), flat[at])
        return flat, np.repeat(np.arange(len(runs)), [len(r) for r in runs])

    def lookup(self, left, right):
        """Per pair of symbols: its merged symbol and rank, NONE where it does not merge."""
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return self.merged[at], np.where(self.keys[at] == pair, self.ranks[at], NONE)

    def merge_long(self, flat, run):
        """Merge rounds that visit only the pairs they merge, for runs in which few pairs share a rank.

        Symbols are linked to their neighbours; places wait in a bucket per rank.  A round
        takes the smallest rank of all runs, merges its leftmost occurrences at once and
        files the pairs this opens.  Symbols that were merged into their left one drop
        out at the end.
        """
        n = len(flat)
        symbol, alive = flat.copy(), np.ones(n, bool)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        border = np.flatnonzero(run[1:] != run[:-1])
        nxt[border], nxt[n - 1], prv[border + 1] = -1, -1, -1
        rank, merged = np.full(n, NONE, np.int64), np.zeros(n, np.int64)
        buckets, waiting = {}, []

        def file(places):
            places = places[nxt[places] >= 0]
            merged[places], rank[places] = self.lookup(symbol[places], symbol[nxt[places]])
            places = places[rank[places] < NONE]
            for place, r in zip(places.tolist(), rank[places].tolist()):
                if r not in buckets:
                    buckets[r] = []
                    heapq.heappush(waiting, r)
                buckets[r].append(place)

        file(np.arange(n))
        while waiting:
            r = heapq.heappop(waiting)
            hit = np.unique(buckets.pop(r))
            hit = hit[alive[hit] & (rank[hit] == r)]
            if not len(hit):
                continue
            if self.one_by_one[r]:
                first = np.r_[True, run[hit[1:]] != run[hit[:-1]]]
                if not first.all():
                    buckets[r] = hit[~first].tolist()
                    heapq.heappush(waiting, r)
                take = hit[first]
            else:
                new_row = np.r_[True, nxt[hit[:-1]] != hit[1:]]
                at = np.arange(len(hit))
                take = hit[(at - np.maximum.accumulate(np.where(new_row, at, 0))) % 2 == 0]
            gone = nxt[take]
            symbol[take], after = merged[take], nxt[gone]
            alive[gone], rank[gone], rank[take] = False, NONE, NONE
            nxt[take] = after
            prv[after[after >= 0]] = take[after >= 0]
            before = prv[take]
            rank[before[before >= 0]] = NONE
            file(np.unique(np.r_[take, before[before >= 0]]))
        return symbol[alive], run[alive]

    def merge(self, flat, run):
        """Merge until no pair remains; returns symbols and runs, in run order."""
        long_ = np.bincount(run)[run] > LONG_RUN if len(run) else np.zeros(0, bool)
        if long_.any():
            parts = [self.merge_long(flat[long_], run[long_])]
            if not long_.all():
                parts.append(self.merge(flat[~long_], run[~long_]))
            flat, run = (np.concatenate(p) for p in zip(*parts))
            order = np.argsort(run, kind="stable")
            return flat[order], run[order]
        done = []
        while len(flat) > 1:
            pair = flat[:-1] * self.base + flat[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (run[:-1] == run[1:])
            rank = np.where(known, self.ranks[at], NONE)
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            lengths = np.diff(np.r_[starts, len(run)])
            best = np.minimum.reduceat(np.r_[rank, NONE], starts)
            active = best < NONE
            if not active.all():  # finished runs leave
                stays = np.repeat(active, lengths)
                done.append((flat[~stays], run[~stays]))
                # A pair goes with its left symbol; the last of a run holds NONE.
                flat, run = flat[stays], run[stays]
                if not len(flat):
                    break
                at, rank = at[stays[:-1]][:len(flat) - 1], rank[stays[:-1]][:len(flat) - 1]
                best, lengths = best[active], lengths[active]
            hit = np.flatnonzero(rank == np.repeat(best, lengths)[:-1])
            hit = hit[rank[hit] < NONE]
            new_row = np.r_[True, np.diff(hit) > 1]
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(new_row, np.arange(len(hit)), 0))
            first = np.r_[True, run[hit[1:]] != run[hit[:-1]]]
            take = hit[np.where(self.one_by_one[rank[hit]], first, since % 2 == 0)]
            flat[take] = self.merged[at[take]]
            left = np.ones(len(flat), bool)
            left[take + 1] = False
            flat, run = flat[left], run[left]
        done.append((flat, run))
        flat = np.concatenate([f for f, _ in done])
        run = np.concatenate([r for _, r in done])
        order = np.argsort(run, kind="stable")
        return flat[order], run[order]

    def encode_runs(self, runs: list):
        """Ids of all runs, flat, and the number of ids of each."""
        flat, run = self.merge(*self.symbols(runs))
        ids = flat
        odd = np.flatnonzero(flat >= self.size)
        if len(odd):  # characters without a piece: their UTF-8 bytes
            spelled = [self.byte_ids[list(chr(c - self.size).encode())] for c in flat[odd].tolist()]
            sizes = np.ones(len(flat), np.int64)
            sizes[odd] = [len(s) for s in spelled]
            ids = np.repeat(flat, sizes)
            ids[np.repeat(np.isin(np.arange(len(flat)), odd), sizes)] = np.concatenate(spelled)
            run = np.repeat(run, sizes)
        return ids.astype(np.int32), np.bincount(run, minlength=len(runs))

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, byte pieces read as UTF-8, one leading space dropped."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.texts[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


class _Index(dict):
    """Numbers runs in the order of their first appearance."""

    def __missing__(self, run):
        self[run] = found = len(self)
        return found


class Encoder:
    """Encodes and decodes batches of texts; remembers runs it has met."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.split = (lambda t: [t]) if model.whole_text else re.compile(" +[^ ]*").findall
        self.clear()

    def clear(self):
        self.index = _Index()
        self.ids = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)
        self.decoded = []

    def batch(self, texts: list):
        """Per text its ids (flat, with counts) and its decoded text."""
        if len(self.ids) > POOL_SYMBOLS:
            self.clear()
        index, rows, sizes = self.index, [], []
        known = len(index)
        for text in texts:
            runs = self.split(" " + text.replace(SPACE, " ")) if text else []
            rows.append([index[r] for r in runs])
            sizes.append(len(runs))
        if len(index) > known:
            new = list(index)[known:]
            ids, counts = self.model.encode_runs(new)
            self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(counts)]
            self.ids = np.r_[self.ids, ids]
            ends = np.cumsum(counts)
            listed = ids.tolist()
            self.decoded += [
                self.model.decode(listed[e - c:e]) for e, c in zip(ends.tolist(), counts.tolist())
            ]
        picked = np.fromiter((i for row in rows for i in row), np.int64, sum(sizes))
        lengths = (self.starts[1:] - self.starts[:-1])[picked] if len(picked) else picked
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(
            self.starts[picked] - (ends - lengths), lengths
        )
        bounds = np.r_[0, np.cumsum(sizes)]
        upto = np.r_[0, ends][bounds]
        decoded = self.decoded
        # Runs start with a space piece, so bytes of one never join those of the next.
        out = ["".join([decoded[i] for i in row])[1:] for row in rows]
        return self.ids[at], np.diff(upto), out


def encode_decode(docs: DataFrame, model_path: str, text="text", end=True) -> DataFrame:
    """`docs` with `ids` array<int> (replaced if present) and `decoded` string.

    Ids are those of the sentencepiece library for the whole text, followed by
    the end id if `end`; `decoded` is the text of these ids.  A null text counts as
    empty: the end id alone, decoded to ''.  All other columns pass through.  Rows
    stay in their tasks; a task keeps the encodings of the runs it has met, up
    to a fixed number of symbols.
    """
    schema = T.StructType([
        *[f for f in docs.schema if f.name not in ("ids", "decoded")],
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType()),
    ])
    kept = [f.name for f in schema][:-2]

    def run(batches):
        model = PieceModel(model_path)
        encoder = Encoder(model)
        tail = np.array([model.end_id] if end else [], np.int32)
        for whole in batches:
            texts = whole.column(text).cast(pa.large_string())
            lengths = np.cumsum([0 if t is None else t for t in pa.compute.binary_length(texts).to_pylist()])
            cuts = np.flatnonzero(np.diff(np.r_[-1, lengths // BATCH_BYTES])) if len(lengths) else []
            for low, high in zip(cuts, [*cuts[1:], len(lengths)]):
                some = whole.slice(low, high - low)
                flat, counts, decoded = encoder.batch([t or "" for t in texts.slice(low, high - low).to_pylist()])
                ends = np.cumsum(counts)
                flat = np.insert(flat, np.repeat(ends, len(tail)), np.tile(tail, len(ends)))
                offsets = np.r_[0, np.cumsum(counts + len(tail))].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(c) for c in kept], ids, pa.array(decoded, pa.string())],
                    names=[*kept, "ids", "decoded"],
                )

    return docs.mapInArrow(run, schema)
