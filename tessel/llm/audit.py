"""Filter interaction audit by lattice edges.

Five filters can be applied in 120 orders. What a filter removes depends only on the set of filters before it, so a
document counts on lattice edges (applied subset, next filter), 80 of them, and each order is a path of five edges.
Documents are judged once, in Arrow batches, and become a five-bit mask of failures; rows are counted by (part, mask,
labels) before anything is expanded, so 32 masks at most meet the 80 edges of a part, whatever its size. The counts of
the edges are then joined to the 600 steps of all orders. A filter's removals summed over all orders weigh the edge of
a subset of s filters by s! (4 - s)!.

Filter E needs the table: texts are grouped by SHA-256 (with a count for each text before the shuffle, so a text with
very many copies is one row of each task), and the rows at a text's smallest doc_id are found by a join on (text, doc_id),
which spreads such a group over its ids.

Null texts and sources are empty strings, empty texts are equal texts; a null doc_id is smaller than none and none is
smaller than it; repeated rows count each, and rows that share the smallest doc_id of their text all pass E; labels of a
doc_id are joined once (1 where any of its rows says 1), a null doc_id has none; very long texts are judged whole, one batch slice at a time;
an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm._shared import discard, materialize, pieces_of
from tessel.llm._words import whole

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*|")] = True
_CAPITALS = np.zeros(256, bool)
_CAPITALS[65:91] = True


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, bounds of the texts) of a large string array with buffers of its own."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8), bounds


def _per_text(hit: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of true bytes of each text."""
    return np.searchsorted(np.flatnonzero(hit), bounds[1:]) - np.searchsorted(np.flatnonzero(hit), bounds[:-1])


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, distinct words) of each text; words are runs without ASCII white space, as they are written."""
    words = pc.ascii_split_whitespace(texts)
    bounds = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds -= bounds[0]
    solid = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[solid]
    pairs = np.sort(owner * (int(codes.max()) + 1 if len(codes) else 1) + codes[solid])
    first = np.ones(len(pairs), bool)
    first[1:] = pairs[1:] != pairs[:-1]
    size = int(codes.max()) + 1 if len(codes) else 1
    return np.bincount(owner, minlength=len(texts)), np.bincount(pairs[first] // size, minlength=len(texts))


def failures(texts: pa.Array) -> np.ndarray:
    """Bits 1, 2, 4, 8 of each text: it fails A, B, C, D."""
    texts = whole(texts)
    n, kinds = distinct_words(texts)
    data, bounds = _bytes_of(texts)
    points = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    out = (n < LEAST_WORDS).astype(np.int32)
    out |= 2 * (100 * kinds < DISTINCT_PERCENT * n)
    out |= 4 * (100 * _per_text(_CAPITALS[data], bounds) > CAPITAL_PERCENT * points)
    return out | 8 * (_per_text(_MARKS[data], bounds) > 0)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (of A to D), text_key (SHA-256 of the text) of every row."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    schema = rows.select("doc_id", "part", F.lit(0).alias("mask"), F.lit(b"").alias("text_key")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for batch in pieces_of(held, "text"):
                texts = whole(batch.column("text"))
                data, bounds = _bytes_of(texts)
                at = bounds.tolist()
                keys = [hashlib.sha256(data[a:b]).digest() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(failures(texts), pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "part", "mask", "text_key"])

    return rows.mapInArrow(judge, schema)


def with_repeats(rows: DataFrame) -> DataFrame:
    """Rows with bit 16 of the mask where a row with the same text has a smaller doc_id."""
    first = rows.groupBy("text_key").agg(F.min("doc_id").alias("first_id"))
    at_first = first.where("first_id is not null").select(F.col("text_key").alias("__k"), F.col("first_id").alias("__d"), F.lit(True).alias("__first"))
    met = rows.join(at_first, (F.col("text_key") == F.col("__k")) & (F.col("doc_id") == F.col("__d")), "left")
    repeated = F.col("doc_id").isNotNull() & F.col("__first").isNull()
    return met.withColumn("mask", F.col("mask") + F.when(repeated, 16).otherwise(0)).drop("__k", "__d", "__first", "text_key")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows by part and five-bit mask, and those of them that are labelled so."""
    kept = materialize(judged(docs).groupBy("doc_id", "part", "mask", "text_key").agg(F.count(F.lit(1)).alias("n")), "judged")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = with_repeats(kept).join(known, "doc_id", "left")
    marked = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    out = materialize(rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("quality").alias("good"), marked("toxic").alias("toxic")), "masks")
    discard(kept)
    return out


BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: (applied subset, next filter) of all 80 edges.
EDGES = [(s, b) for s in range(32) for b in BIT.values() if not s & b]


def order_steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, applied, next: the 600 steps of all orders, whatever the data."""
    steps = [("".join(p), k + 1, sum(BIT[f] for f in p[:k]), BIT[p[k]]) for p in permutations(FILTERS) for k in range(5)]
    return spark.createDataFrame(steps, "filter_order string, step int, applied int, next int")


def edge_counts(counts: DataFrame) -> DataFrame:
    """part, applied, next and what that filter does to the rows of a part after that subset; zeros included.

    A part has 32 rows of counts at most, each of which is set against the 80 edges.
    """
    edges = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(b).alias("next")) for s, b in EDGES])
    met = counts.select("*", F.inline(edges))
    reached, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(F.col("next")) != 0
    total = lambda cond, c="n": F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long")
    return met.groupBy("part", "applied", "next").agg(
        total(reached & ~fails).alias("kept"), total(reached & fails).alias("removed"), total(~reached & fails).alias("redundant"),
        total(F.col("mask") == F.col("next")).alias("unique_fails"), total(reached & fails, "good").alias("good_lost"), total(reached & fails, "toxic").alias("toxic_lost"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of every step of all 120 orders of the five filters."""
    at_edge = edge_counts(mask_counts(docs, labels))
    size = F.bit_count("applied")
    orders = F.element_at(F.array(*[F.lit(factorial(s) * factorial(4 - s)) for s in range(5)]), size + 1)
    shapley = at_edge.groupBy("part", "next").agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))
    paths = at_edge.join(F.broadcast(order_steps(docs.sparkSession)), ["applied", "next"]).join(shapley, ["part", "next"])
    return paths.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


_ROWS = """SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents"""
ORACLE_SQL = f"""WITH d AS ({_ROWS}),
f AS (SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(l.q, false) AS good, coalesce(l.x, false) AS bad
  FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS q, bool_or(toxic = 1) AS x FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count_if(good) AS g, count_if(bad) AS x FROM f GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k AS step, 1 << (ascii(filter_order[k]) - 65) AS next, list_sum([0] || list_transform(range(1, k), lambda i: 1 << (ascii(filter_order[i]) - 65)))::INT AS applied FROM p, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, next, sum(CASE WHEN mask & (applied | next) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & applied = 0 AND mask & next <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & applied <> 0 AND mask & next <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = next THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & applied = 0 AND mask & next <> 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN mask & applied = 0 AND mask & next <> 0 THEN x ELSE 0 END) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, next))::BIGINT AS shapley FROM r"""
