"""Near-duplicate documents by circulant MinHash, exact Jaccard verification and connected components.

Each document's set of word shingles is permuted once (the shingle hash times an odd constant, cut to a position); a
second permutation, circularly shifted by k, gives the k-th signature coordinate. BANDS bands of ROWS coordinates make
bucket keys; at a similarity of 0.8 a pair shares no bucket with a probability of (1 - 0.8^7)^50 < 1e-5.

Documents with equal sets are one class from the start. Within a bucket each class is compared with the bucket's hub,
the class that shares most buckets. Links are confirmed on the full sets (hashed to 64 bits), and only pairs that
components don't connect yet are looked at again. What is left are classes that a bucket holds beside its hub's
component: two such sets x and y can only reach the threshold if they share enough of their differences from the hub,
since |x & y| = |hub| - |dx| - |dy| + shared differences. So differences are joined by an exact prefix filter, the
rarest of a hub first, and the survivors are verified. A large group costs a few comparisons per document, not all
pairs, and no pair of a bucket goes unexamined.

Components come from alternating large-star and small-star joins. Pairs, sets and components stay in distributed
tables, which go once what follows from them is written; joins on a hot hub, bucket or component can be split by Spark,
and counts are pre-aggregated.

Null texts and texts without a word have no shingle, are linked with nothing and are kept. Texts with fewer words than
a shingle are one shingle of them all. Repeated rows are copies of each other: component_id is the smallest doc_id
reachable, and of several rows with it one is kept. An empty table gives no row; extra columns are ignored by
near_duplicates and kept by drop_near_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._shared import BROADCAST_BYTES, discard, materialize, pieces_of, small
from tessel.llm._words import blank_words, mix, shingle_hashes, word_hashes

THRESHOLD = 80
BANDS, ROWS = 50, 7
#: Positions of the second permutation.
POSITIONS = 1 << 22
#: Buckets in which a hub's differences are counted; a power of two.
SKETCH = 4096


class Circulant:
    """Signatures of shingle sets; every worker makes the same permutations."""

    _made: dict[tuple[int, int], Circulant] = {}

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.k = bands, rows, bands * rows
        second = np.random.default_rng(20).permutation(POSITIONS).astype(np.uint32)
        self.shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: self.k]]), self.k)
        self.multiplier = np.uint64(0x9E3779B97F4A7C15)
        self.cut = np.uint64(64 - POSITIONS.bit_length() + 1)

    @classmethod
    def get(cls, bands: int, rows: int) -> Circulant:
        if (bands, rows) not in cls._made:
            cls._made[bands, rows] = cls(bands, rows)
        return cls._made[bands, rows]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Coordinate k: the least value, over the set, of the second permutation shifted by k."""
        at = ((shingles * self.multiplier) >> self.cut).astype(np.int64)
        out = self.shifts[at[:2048]].min(axis=0)
        for lo in range(2048, len(at), 2048):
            np.minimum(out, self.shifts[at[lo : lo + 2048]].min(axis=0), out=out)
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        s = signatures.astype(np.uint64).reshape(len(signatures), self.bands, self.rows)
        h = np.broadcast_to(mix(np.arange(1, self.bands + 1, dtype=np.uint64)), s.shape[:2])
        for r in range(self.rows):
            h = mix(h ^ s[:, :, r])
        return h.view(np.int64)


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    hashes, at = shingle_hashes(*word_hashes(blank_words(texts)), n)
    return [np.unique(hashes[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row, text_key, n_shingles, digest (of the set), bands; digest and bands are null without a shingle.

    row is the one of docs (doc_id, text, row), or else numbered over its scan.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Circulant.get(bands, rows)
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                sets = _sets(batch.column("text"), n)
                full = [i for i, s in enumerate(sets) if len(s)]
                signed = np.array([maker.signature(sets[i]) for i in full], dtype=np.uint32).reshape(len(full), bands * rows)
                keys = iter(maker.band_keys(signed)) if full else iter(())
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id"),
                        "row": batch.column("row"),
                        "text_key": batch.column("text_key"),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        "bands": pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    }
                )

    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id().alias("row")
    rows_in = docs.select("doc_id", row, F.md5(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows_in.mapInArrow(sign, f"doc_id {kind}, row long, text_key string, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, its whole set as sorted 64-bit hashes; wanted has (node, text_key)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                yield pa.record_batch([batch.column("node"), pa.array([s.tobytes() for s in _sets(batch.column("text"), n)], pa.binary())], names=["node", "shingles"])

    texts = docs.select(F.col("text").cast("string").alias("text"), F.md5(F.col("text").cast("string")).alias("text_key"))
    found = texts.join(small(wanted), "text_key").groupBy("node").agg(F.first("text").alias("text"))  # copies meet here
    return found.mapInArrow(gather, "node long, shingles binary")


def verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """pairs (hub, node) with `linked`: whether 100 * intersection >= threshold * union, on the full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if min(len(x), len(y)) * 100 < threshold * max(len(x), len(y)):
                    linked.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(shared * 100 >= threshold * (len(both) - shared))
            yield pa.record_batch([batch.column("hub"), batch.column("node"), pa.array(linked, pa.bool_())], names=["hub", "node", "linked"])

    return _with_sets(pairs, sets).select("hub", "node", "a", "b").mapInArrow(compare, "hub long, node long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b): root is the component's smallest node."""
    stars = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        mark = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        hint = F.broadcast if mark["n"] * 16 <= BROADCAST_BYTES else lambda d: d  # two long columns at most
        last, both = stars, stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(hint(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small_stars = large.join(hint(lower), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialize(small_stars.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(last)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _differences(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """hub, node, need, cost, features: how a node's set differs from its hub's.

    Sets x and y reach the threshold only if they share need(x) + cost(y) differences (or need(y) + cost(x)); need is
    positive for a node that isn't linked to the hub.
    """
    r = threshold / (100 + threshold)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need, cost, features = [], [], []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                hub, own = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                more = np.setdiff1d(own, hub, assume_unique=True)
                less = np.setdiff1d(hub, own, assume_unique=True)
                cost.append((1 - r) * len(less) + r * len(more))
                need.append(cost[-1] + (2 * r - 1) * len(hub))
                features.append(np.concatenate([more, ~less]).view(np.int64))
            yield pa.record_batch([batch.column("hub"), batch.column("node"), pa.array(need, pa.float64()), pa.array(cost, pa.float64()), pa.array(features, pa.list_(pa.int64()))], names=["hub", "node", "need", "cost", "features"])

    both = _with_sets(pairs, sets).select("hub", "node", "a", "b")
    return both.mapInArrow(differ, "hub long, node long, need double, cost double, features array<long>")


def _by_rarity(group: DataFrame) -> DataFrame:
    """group with by_rarity for features: those that another component may have too, the rarest of the hub first.

    Features are counted by hub in SKETCH buckets, so that a hub's counts are one small row. A bucket that a single
    component fills holds no feature that links two of them; any order will do for a prefix filter, rare ones first.
    """
    single = group.select("hub", "root", F.explode("features").alias("f"))
    counted = single.groupBy("hub", F.col("f").bitwiseAND(SKETCH - 1).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    counted = counted.where("lo <> hi").groupBy("hub").agg(F.collect_list(F.struct("b", F.least(F.lit(255), F.floor(F.log2("c") * 8)).cast("int").alias("c"))).alias("counts"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for counts in batch.column("counts").to_pylist():
                own = np.zeros(SKETCH, np.uint8)
                own[[x["b"] for x in counts]] = [x["c"] for x in counts]
                out.append(own.tobytes())
            yield pa.record_batch([batch.column("hub"), pa.array(out, pa.binary())], names=["hub", "sketch"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for features, sketch in zip(batch.column("features"), batch.column("sketch").to_pylist()):
                f = features.values.to_numpy()
                c = np.frombuffer(sketch, np.uint8)[f & (SKETCH - 1)]
                f, c = f[c > 0], c[c > 0]
                out.append(f[np.lexsort((f, c))])
            yield pa.record_batch([*(batch.column(k) for k in kept), pa.array(out, pa.list_(pa.int64()))], names=[*kept, "by_rarity"])

    kept = ["hub", "node", "root", "hub_root", "need", "cost"]
    sketches = materialize(counted.mapInArrow(dense, "hub long, sketch binary"), "sketches")
    return group.join(sketches, "hub").select(*kept, "features", "sketch").mapInArrow(rank, "hub long, node long, root long, hub_root long, need double, cost double, by_rarity array<long>")


def _side_pairs(pairs: DataFrame, sets: DataFrame, roots: DataFrame, threshold: int) -> DataFrame:
    """(hub, node) pairs of different components that can be linked beside a common hub."""
    named = _rooted(pairs.where("n > 2"), roots)
    open_hubs = materialize(named.where("root <> hub_root").select("hub").distinct(), "open")
    group = materialize(_rooted(_differences(named.join(small(open_hubs), "hub").select("hub", "node"), sets, threshold), roots), "differences")
    sides = materialize(_by_rarity(group), "ranked")
    discard(open_hubs, group)
    shared = F.size("by_rarity")
    head = lambda least: F.slice("by_rarity", F.lit(1), F.greatest(F.lit(0), shared - F.greatest(F.lit(1), least.cast("int")) + 1))
    own = sides.where("root <> hub_root").select("hub", F.col("node").alias("x"), F.col("root").alias("x_root"), "need", shared.alias("x_size"), F.posexplode(head(F.ceil(F.col("need") - 1e-9))).alias("x_at", "f"))
    other = sides.select("hub", F.col("node").alias("y"), F.col("root").alias("y_root"), "cost", shared.alias("y_size"), F.posexplode(head(F.floor(F.col("cost") - 1e-9) + 1)).alias("y_at", "f"))
    # of what a pair shares, nothing stands before its first common difference
    left = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    met = own.join(other, ["hub", "f"]).where((F.col("x_root") != F.col("y_root")) & (F.col("need") + F.col("cost") - 1e-9 <= left))
    beside = materialize(met.select(F.least("x", "y").alias("hub"), F.greatest("x", "y").alias("node")).distinct(), "beside")
    discard(sides)
    return beside


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (hub, node) with their sets, a and b."""
    first = pairs.join(sets.withColumnRenamed("shingles", "b"), "node")
    return first.join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("a")), "hub")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs with the components of both ends: hub_root, root."""
    few = small(roots)
    out = pairs.join(few.select(F.col("node").alias("__n"), F.col("root").alias("__r")), F.col("node") == F.col("__n"), "left").withColumn("root", F.coalesce("__r", "node")).drop("__n", "__r")
    return out.join(few.select(F.col("node").alias("__n"), F.col("root").alias("__r")), F.col("hub") == F.col("__n"), "left").withColumn("hub_root", F.coalesce("__r", "hub")).drop("__n", "__r")


def link_classes(classes: DataFrame, docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """(node, root) for the classes (node, text_key, n_shingles, bands) that link to another class."""
    spark = classes.sparkSession
    banded = classes.select("node", "n_shingles", F.explode("bands").alias("key"))
    # aggregates are written before they are joined, so that Spark can split a hot bucket
    sizes = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    multi = materialize(banded.join(small(sizes), "key"), "buckets")
    score = materialize(multi.groupBy("node").agg(F.sum("n").alias("score")), "scores")
    scored = multi.join(small(score), "node")
    hubs = materialize(scored.groupBy("key").agg(F.max(F.struct("score", "node", "n_shingles")).alias("hub")), "hubs")
    shared = scored.join(small(hubs), "key").where("node <> hub.node")
    pairs = shared.groupBy(F.col("hub.node").alias("hub"), "node").agg(F.max("hub.score").alias("hub_score"), F.max("hub.n_shingles").alias("hub_n"), F.max("n_shingles").alias("n_shingles"), F.max("n").alias("n"))
    pairs = materialize(pairs, "pairs")
    wanted = materialize(classes.join(small(score), "node", "left_semi").select("node", "text_key"), "wanted")
    sets = materialize(shingle_sets(docs, wanted, n), "sets")

    def examine(part: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(verified pairs, components after them)."""
        checked = materialize(verify(part, sets, threshold), "checked")
        links = checked.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
        if not links.take(1):
            return checked, roots
        return checked, materialize(components(links.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))), "roots")

    roots = materialize(spark.createDataFrame([], "node long, root long"), "roots")
    near = pairs.where(F.least("n_shingles", "hub_n") * 100 >= F.greatest("n_shingles", "hub_n") * threshold)
    first = near.groupBy("node").agg(F.max(F.struct("hub_score", "hub")).alias("h")).select("h.hub", "node")
    checked, roots = examine(first, roots)
    apart = _rooted(near, roots).where("root <> hub_root").select("hub", "node")
    rest = materialize(apart.join(small(checked.select("hub", "node")), ["hub", "node"], "left_anti"), "rest")
    if rest.take(1):
        _, roots = examine(rest, roots)
    sides = _side_pairs(pairs, sets, roots, threshold)
    if sides.take(1):
        _, roots = examine(sides, roots)
    discard(sizes, multi, score, hubs, pairs, wanted, sets, checked, rest, sides)
    return roots


def _judged(docs: DataFrame, n: int, threshold: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept of every row of docs, written."""
    signed = materialize(signatures(docs, n, bands, rows), "signatures")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.first("n_shingles").alias("n_shingles"), F.min("text_key").alias("text_key"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = link_classes(classes, docs, n, threshold)
    named = materialize(classes.select("digest", "node").join(small(roots), "node", "left").select("digest", F.coalesce("root", "node").alias("root")), "named")
    members = materialize(signed.drop("bands", "text_key").join(named, "digest", "left"), "members")
    discard(signed, classes, roots, named)
    best = members.where("root is not null").groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")).alias("first"))
    best = materialize(best.where("rows > 1").select("root", "first"), "first")  # written, so that Spark can split a hot root in the join
    out = members.join(small(best), "root", "left").select(
        "doc_id", "row", "n_shingles",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (F.col("first").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"),
    )
    out = materialize(out, "judged")
    discard(members, best)
    return out


def near_duplicates(docs: DataFrame, n: int = 5, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for documents (doc_id, text), linked by n-word shingles."""
    return _judged(docs.select("doc_id", "text"), n, threshold, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each component, all columns as they are.

    docs is written once with its row ids, and judged and filtered from there, so its own scan may change.
    """
    row = "__row"
    while row in docs.columns:
        row += "_"
    written = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    judged = _judged(written.select("doc_id", "text", F.col(row).alias("row")), n, threshold, bands, rows)
    dropped = materialize(judged.where("not kept").select(F.col("row").alias(row)), "dropped")
    discard(judged)
    return written.join(small(dropped), row, "left_anti").drop(row)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
c AS (SELECT doc_id AS a, doc_id AS root FROM documents UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(c.root) AS component_id, min(c.root) = d.doc_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
