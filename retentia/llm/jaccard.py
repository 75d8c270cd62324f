"""Exact Jaccard join of documents on word shingles, as a metric-space join.

Jaccard distance is a metric, and so is the size of the symmetric difference, which
a similarity of at least s bounds by (1 - s) / (1 + s) times the sum of both sizes.

* Equal sets are one class from the start.
* Unrelated texts are all at distance 1 from any document, so pivots that are
  documents cannot part them.  The first pivots are therefore sets that are no
  documents.  The empty set parts by size into rings; by the triangle inequality a
  set can only link into its ring or the next smaller one, and is replicated
  there if it reaches that far.  Within a ring the universe of shingles is cut into
  more parts than linked sets can differ in shingles; in at least one part both
  have equal projections, so the cells of equal projections are the regions and
  a set is in one region per part.
* Sets that meet in regions form families, which hold every link.  A family is
  joined exactly with documents as pivots: each document goes to the Voronoi
  region of its nearest pivot, and to every other region whose pivot is at most
  2 t further away (t the link distance); regions join recursively.  Where that no
  longer parts them, the distances to pivots prune pairs by the triangle
  inequality, and documents already connected are not compared again.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from retentia.llm.common import attach, free_name, running_sums
from retentia.llm.components import components, star_edges
from retentia.sources.staging import stage

WORDS = 3
SIMILARITY = 90  # per cent
PIVOTS = 16
LEAF = 256  # documents compared without further regions
TILE_COST = 1 << 25  # bytes of sets that one task holds for one side
ROW_COST = 1 << 13
CACHE = 1_000_000
BATCH_BYTES = 4_000_000  # regions per output batch

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes; remembers hashes of words."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct shingles; a text of fewer words is one shingle, none gives none."""
        found = (text or "").encode("utf-8", "replace").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for word in set(found):
            if word not in known:
                known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        h = np.array([known[w] for w in found], np.uint64)
        size = min(self.words, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - size + 1, np.uint64(size), np.uint64)
            for i in range(size):
                out = _mixed(out * _ODD + h[i:len(h) - size + 1 + i])
        return np.unique(out)


# -- rings and parts ------------------------------------------------------------

def _ring_starts(most: int, similarity: int) -> list:
    """Smallest sizes of rings; sets linked to a ring's sets are in it or the next."""
    starts = [1]
    while starts[-1] <= most:
        at = starts[-1]
        for _ in range(2):  # two steps wide, so that about half the sets stay in one ring
            at = max(at + 1, -(-at * 100 // similarity))
        starts.append(at)
    return starts


def regions(shingles: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Regions of a set, as hashes of (ring, part, projection)."""
    n = len(shingles)
    if not n:
        return np.empty(0, np.int64)
    starts = _ring_starts(n, similarity)
    ring = len(starts) - 2
    out = [_projections(shingles, ring, starts, similarity)]
    # The smallest set this one can link to may lie in the ring below.
    if ring and -(-n * similarity // 100) < starts[ring]:
        out.append(_projections(shingles, ring - 1, starts, similarity))
    return np.concatenate(out).astype(np.int64)


def _projections(shingles, ring, starts, similarity):
    """Linked sets of a ring differ in at most `apart` shingles; there are two parts more.

    So two parts at least agree.  Empty projections only count if a set has two of
    them, as otherwise another part must agree as well.
    """
    smaller = starts[ring + 1] - 1
    larger = smaller * 100 // similarity
    apart = (100 - similarity) * (smaller + larger) // (100 + similarity)
    if not apart:
        return np.empty(0, np.uint64)  # linked sets are equal
    parts = apart + 2
    with np.errstate(over="ignore"):
        part = ((shingles >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
        sums = np.zeros(parts, np.uint64)
        sums[part[order][heads]] = np.add.reduceat(_mixed(shingles[order] + _ODD), heads)
        filled = np.zeros(parts, bool)
        filled[part] = True
        tagged = _mixed(sums + _mixed(np.arange(parts, dtype=np.uint64) + np.uint64(ring << 32)))
    return tagged if parts - filled.sum() > 1 else tagged[filled]


# -- joining one family in a task ---------------------------------------------------

class Family:
    """Sets of one family, joined by regions around pivots."""

    def __init__(self, sets: list, similarity: int = SIMILARITY):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat = at.astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.kinds = int(self.flat.max()) + 1
        self.similarity = similarity
        self.reach = 1 - similarity / 100 + 1e-9
        self.label = np.arange(len(sets))
        self.members = {i: [i] for i in range(len(sets))}
        self.edges = []

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x with others."""
        own = np.zeros(self.kinds, bool)
        own[self.flat[self.ends[x] - self.sizes[x]:self.ends[x]]] = True
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(self.ends[others] - sizes - (ends - sizes), sizes)
        return np.add.reduceat(own[self.flat[at]].astype(np.int64), ends - sizes)

    def meet(self, x: int, others: np.ndarray) -> np.ndarray:
        """Distances from x; documents found linked join its component."""
        both = self.common(x, others)
        union = self.sizes[x] + self.sizes[others] - both
        for y in others[100 * both >= self.similarity * union].tolist():
            self._connect(x, y)
        return 1 - both / union

    def _connect(self, x, y):
        a, b = self.label[x], self.label[y]
        if a == b:
            return
        self.edges.append((x, y))
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.label[moved] = a
        self.members[a] += moved

    def join(self, docs: np.ndarray, depth: int = 0) -> None:
        """Find what connects `docs` (rows), by Voronoi regions while they part."""
        if len(docs) <= LEAF:
            return self.compare(docs, np.empty((0, len(docs))))
        pivots = docs[np.unique(np.linspace(0, len(docs) - 1, PIVOTS).astype(int))]
        gaps = np.stack([self.meet(p, docs) for p in pivots.tolist()])
        nearest = gaps.min(0)
        # Replicated: at most twice the link distance further than the nearest pivot.
        cells = [docs[row <= nearest + 2 * self.reach] for row in gaps]
        if max(map(len, cells)) <= 0.7 * len(docs) and sum(map(len, cells)) <= 3 * len(docs):
            own = gaps.argmin(0)
            for i, cell in enumerate(cells):
                if len(cell) > 1 and (own == i).any():
                    self.join(cell, depth + 1)
        else:
            self.compare(docs, gaps)

    def compare(self, docs: np.ndarray, gaps: np.ndarray) -> None:
        """Each document against later ones of other components that no pivot rules out."""
        sizes = self.sizes[docs]
        order = np.argsort(self.sizes[docs], kind="stable")
        docs, gaps, sizes = docs[order], gaps[:, order], sizes[order]
        for i in range(len(docs) - 1):
            stop = np.searchsorted(sizes, sizes[i] * 100 // self.similarity, "right")
            open_ = i + 1 + np.flatnonzero(self.label[docs[i + 1:stop]] != self.label[docs[i]])
            if len(open_) and len(gaps):
                open_ = open_[(np.abs(gaps[:, open_] - gaps[:, i:i + 1]) <= self.reach).all(0)]
            if len(open_):
                self.meet(int(docs[i]), docs[open_])


def family_edges(ids: np.ndarray, texts: list, similarity: int = SIMILARITY):
    """Edges (smallest id, id) that connect the documents of one family."""
    shingler = Shingler()
    sets = [shingler.shingles(t) for t in texts]
    filled = [i for i, s in enumerate(sets) if len(s)]
    if len(filled) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    family = Family([sets[i] for i in filled], similarity)
    family.join(np.arange(len(filled)))
    ends = np.array(family.edges, np.int64).reshape(-1, 2)
    own = ids[filled]
    return star_edges(own[ends[:, 0]], own[ends[:, 1]])


# -- on tables ------------------------------------------------------------------

def _shingled(docs: DataFrame, similarity: int) -> DataFrame:
    """id, n_shingles, digest of the set (null if empty), regions."""
    def batch(ids, sizes, digests, found):
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int64), *found])
        return pa.RecordBatch.from_arrays([
            ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
        ], names=["id", "n_shingles", "digest", "regions"])

    def run(batches):
        shingler = Shingler()
        for whole in batches:
            start, held, sizes, digests, found = 0, 0, [], [], []
            for row, text in enumerate(whole.column("text")):
                own = shingler.shingles(text.as_py())
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                found.append(regions(own, similarity))
                held += found[-1].nbytes
                if held >= BATCH_BYTES:
                    yield batch(whole.column("id").slice(start, row + 1 - start), sizes, digests, found)
                    start, held, sizes, digests, found = row + 1, 0, [], [], []
            if found:
                yield batch(whole.column("id").slice(start), sizes, digests, found)

    return docs.mapInArrow(run, "id long, n_shingles long, digest binary, regions array<long>")


def jaccard_components(docs: DataFrame, key="doc_id", text="text", similarity: int = SIMILARITY) -> DataFrame:
    """Per row of `docs`: key, n_shingles, component_id.

    Two documents link if 100 times their common shingles are at least `similarity`
    times all their shingles.  component_id is the smallest key reachable by
    links.  Texts that are null or without words have no shingles and link with
    nothing; rows with a null key link with nothing and have a null component;
    rows that repeat a key are one document with several texts.  Other columns are
    not read; an empty table gives no rows.  Shingles are 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    facts = stage(_shingled(texts, similarity), "shingled")
    linkable = facts.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    classes = stage(linkable.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    placed = (
        linkable.select("id", "digest", "n_shingles", "regions")
        .join(classes, (F.col("id") == F.col("rep")) & (linkable["digest"] == classes["digest"]))
        .select("rep", "n_shingles", F.explode("regions").alias("region"))
    )
    met = stage(
        placed.groupBy("region").agg(
            F.min("rep").alias("u"), F.max("rep").alias("v"), F.count("*").alias("n")
        ).where("u < v"),
        "regions",
    )
    crowded = met.where("n > 2").select("region", "u")
    pairs = met.select("u", "v").unionByName(
        placed.join(crowded, "region").where("rep != u").select("u", F.col("rep").alias("v"))
    )
    family = stage(components(pairs.distinct()).withColumnRenamed("component", "family"), "families")
    sized = stage(
        linkable.groupBy("id").agg(F.sum("n_shingles").alias("n_shingles"))
        .join(family, F.col("id") == F.col("node"))
        .select("id", "family", (F.col("n_shingles") * 8 + ROW_COST).alias("cost")),
        "members",
    )
    tiled = stage(
        running_sums(sized, ["id"], {"upto": "cost"}, within="family")
        .withColumn("tile", F.floor((F.col("upto") - F.col("cost")) / F.lit(TILE_COST)).cast("int"))
        .select("id", "family", "tile"),
        "tiled",
    )
    tiles = stage(tiled.groupBy("family").agg(F.max("tile").alias("last")), "tiles")
    members = attach(tiled, tiles, "family").select(
        "id", "family", "tile", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    ).select("id", "family", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))

    def connect(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        low, high = family_edges(group["id"].to_numpy(), group["text"].tolist(), similarity)
        return pd.DataFrame({"u": low, "v": high})

    edges = stage(
        texts.join(members, "id").groupBy("family", "a", "b").applyInPandas(connect, "u long, v long"),
        "links",
    )
    reached = components(edges).withColumnRenamed("node", "rep")
    of_class = stage(
        classes.join(reached, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")),
        "of-class",
    )
    # A repeated key may stand in several classes; they share what any of them reaches.
    found = attach(facts.select("id", "n_shingles", "digest"), of_class, "digest")
    return found.select(
        F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id")
    )


def keep_first(docs: DataFrame, key="doc_id", text="text", similarity: int = SIMILARITY) -> DataFrame:
    """`docs` without all but the smallest key of each component; null keys stay."""
    found = jaccard_components(docs, key, text, similarity)
    gone = free_name(docs, "_gone")
    dropped = found.where(F.col("component_id") != F.col(key)).select(F.col(key).alias(gone)).distinct()
    return docs.join(dropped, F.col(key) == F.col(gone), "left_anti")
