"""Source divergence audit by two-dimensional group-block tiling.

Terms are counted in Arrow batches by (lang, source), with the documents that hold them; counts of a batch are merged
there and again before the shuffle, so a source with most of the rows is a few rows of each task. A lang keeps the terms
that stand in at least LEAST_DOCUMENTS of its documents. Kept terms are dealt by hash to vocabulary chunks of about CHUNK
terms and numbered within them; nothing numbers a whole vocabulary in one task.

The counts of a block of GROUPS groups in one chunk are packed into arrays, at most GROUPS times the chunk's terms long.
Each packed row is replicated to the tiles (block, block) that its block takes part in, and a task takes STRIPE
successive chunks of a tile: it unpacks two small dense matrices for each chunk and adds to the tile's submatrix of
distances. The submatrices of all stripes are summed. Memory follows block and chunk, not groups or vocabulary.

All arithmetic is exact: a probability in billionths is 1 + floor(10^9 (count + 5) / (N + 5 V)), divided in three steps
of a thousand, so that 64 bits hold for sums up to 9 * 10^15. Each pair's distance is a sum over all kept terms: an
absent term counts 0 occurrences.

Null text, lang and source are empty strings; a group without terms is there with counts of 0; a lang without kept terms
has distances of 0 and no term rows; repeated rows count each; very long texts are counted whole, one batch slice at a
time; ties are ordered by the item's bytes; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm._shared import discard, materialize, pieces_of, small
from tessel.llm._words import whole

LEAST_DOCUMENTS, SMOOTHING, BILLION, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Groups of a block, kept terms of a vocabulary chunk (on average), and successive chunks that one task takes.
GROUPS, CHUNK, STRIPE = 16, 2048, 8
#: ASCII letters to lower case, other ASCII to a space, everything else as it is.
_TERM_BYTES = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text of each term, distinct terms, index of each term among them), all texts in a row."""
    texts = whole(texts)
    data = texts.buffers()[2]
    mapped = pa.py_buffer(data.to_pybytes().translate(_TERM_BYTES)) if data is not None else None
    words = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], mapped))
    bounds = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.slice(bounds[0], bounds[-1] - bounds[0])
    solid = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    held = flat.dictionary_encode()
    return np.repeat(np.arange(len(texts)), np.diff(bounds))[solid], held.dictionary, held.indices.to_numpy().astype(np.int64)[solid]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, held (documents of the group that hold it); a group without terms has none."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for batch in pieces_of(held, "text"):
                owner, terms, code = terms_of(batch.column("text"))
                if not len(code):
                    continue
                langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
                n_sources, n_terms = len(sources.dictionary), len(terms)
                group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
                pairs, times = np.unique(owner * n_terms + code, return_counts=True)
                at, where = np.unique(group[pairs // n_terms] * n_terms + pairs % n_terms, return_inverse=True)
                total = np.zeros(len(at), np.int64)
                np.add.at(total, where, times)
                of, term = at // n_terms, at % n_terms
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(of // n_sources)), sources.dictionary.take(pa.array(of % n_sources)), terms.take(pa.array(term)).cast(pa.string()), pa.array(total), pa.array(np.bincount(where, minlength=len(at)).astype(np.int64))],
                    ["lang", "source", "term", "count", "held"],
                )

    found = rows.mapInArrow(count, "lang string, source string, term string, count long, held long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("held").alias("held"))


def kept_terms(counts: DataFrame, least: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(lang, term, chunk, at (number within the chunk), lang_count of the terms in `least` documents of their lang or more; lang, terms, lang_total)."""
    by_lang = counts.groupBy("lang", "term").agg(F.sum("held").alias("held"), F.sum("count").alias("lang_count")).where(F.col("held") >= least)
    by_lang = materialize(by_lang.drop("held"), "kept")
    sizes = materialize(by_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_count").alias("lang_total")), "sizes")
    dealt = by_lang.join(small(sizes), "lang")  # a row of each lang
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / chunk)).cast("int"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    out = materialize(numbered.withColumn("width", F.count(F.lit(1)).over(Window.partitionBy("lang", "chunk")).cast("int")), "vocabulary")
    discard(by_lang)
    return out, sizes


def billionths(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exactly."""
    below = np.maximum(total + SMOOTHING * terms, 1)
    whole_part, rest = np.divmod(count + SMOOTHING, below)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, below)
        whole_part = whole_part * 1000 + step
    return whole_part + 1


def share(count: str, total: str, terms: str) -> Column:
    """The same as a column."""
    return F.expr(f"1 + cast({BILLION} as decimal(20,0)) * cast({count} + {SMOOTHING} as decimal(18,0)) div cast({total} + {SMOOTHING} * {terms} as decimal(20,0))")


def tile_distances(packed: DataFrame, groups: DataFrame, stripe: int) -> DataFrame:
    """lang, a, b (numbers of groups, a < b), value: sums of |p - q| over all kept terms.

    packed: lang, block, chunk, width, terms, cells (g, at, count); groups: lang, block, blocks, g, total.
    """
    totals = groups.groupBy("lang", "block").agg(F.first("blocks").alias("blocks"), F.sort_array(F.collect_list(F.struct("g", "total"))).alias("members"))  # a block's groups
    rows = packed.join(small(totals), ["lang", "block"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = rows.select("*", other).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other"), "stripe": F.floor(F.col("chunk") / stripe)})

    def dense(cells: pa.Array, members: list[dict], width: int, terms: int) -> np.ndarray:
        """Billionths of a block's groups for the terms of a chunk."""
        first = members[0]["g"]
        counts = np.zeros((len(members), width), np.int64)
        flat = cells.values
        counts[flat.field("g").to_numpy() - first, flat.field("at").to_numpy()] = flat.field("count").to_numpy()
        return billionths(counts, np.array([[m["total"]] for m in members], np.int64), terms)

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks().sort_by([("chunk", "ascending"), ("block", "ascending")])
        lang, x, y = (tile.column(c)[0].as_py() for c in ("lang", "x", "y"))
        chunk, block = tile.column("chunk").to_numpy(), tile.column("block").to_numpy()
        sums, sides = None, {}
        for c in np.unique(chunk):  # successive vocabulary chunks
            for i in np.flatnonzero(chunk == c).tolist():
                row = tile.slice(i, 1)
                one = row.column("cells").combine_chunks()
                one = one.take(pa.array([0])) if not isinstance(one, pa.ChunkedArray) else one.chunk(0).take(pa.array([0]))
                sides[int(block[i])] = dense(one, row.column("members")[0].as_py(), row.column("width")[0].as_py(), row.column("terms")[0].as_py())
            p, q = sides[x], sides[y]
            part = np.array([np.abs(q - own).sum(axis=1) for own in p])
            sums = part if sums is None else sums + part
        first = {b: tile.column("members")[int(np.flatnonzero(block == b)[0])][0]["g"].as_py() for b in (x, y)}
        a, b = np.meshgrid(first[x] + np.arange(sums.shape[0]), first[y] + np.arange(sums.shape[1]), indexing="ij")
        keep = a < b
        n = int(keep.sum())
        return pa.table({"lang": pa.array([lang] * n, pa.string()), "a": pa.array(a[keep], pa.int32()), "b": pa.array(b[keep], pa.int32()), "value": pa.array(sums[keep], pa.int64())})

    parts = tiles.groupBy("lang", "x", "y", "stripe").applyInArrow(run, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, block: int = GROUPS, chunk: int = CHUNK, stripe: int = STRIPE) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    counts = materialize(term_counts(docs), "terms")
    vocabulary, sizes = kept_terms(counts, least, chunk)
    there = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    cells = materialize(counts.join(vocabulary.select("lang", "term", "chunk", "at", "width", "terms", "lang_count", "lang_total"), ["lang", "term"]), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # groups of a lang: the result holds their square
    last = F.floor((F.count(F.lit(1)).over(Window.partitionBy("lang")) - 1) / block)
    groups = there.join(totals, ["lang", "source"], "left").withColumn("g", number)
    groups = groups.withColumns({"block": F.floor(F.col("g") / block).cast("int"), "blocks": (last + 1).cast("int")})
    groups = materialize(groups.join(small(sizes.select("lang", "terms")), "lang", "left").na.fill(0, ["total", "terms"]), "groups")
    discard(counts, sizes)

    # every block has a row for every chunk of its lang, if only an empty one
    grid = vocabulary.groupBy("lang", "chunk").agg(F.first("width").alias("width"), F.first("terms").alias("terms"))
    grid = grid.join(groups.select("lang", "block").distinct(), "lang")
    numbered = cells.join(small(groups.select("lang", "source", "g", "block")), ["lang", "source"])
    filled = numbered.groupBy("lang", "block", "chunk").agg(F.collect_list(F.struct("g", "at", "count")).alias("cells"))
    packed = grid.join(filled, ["lang", "block", "chunk"], "left")
    packed = packed.withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<g:int,at:int,count:bigint>>")))
    found = tile_distances(packed, groups, stripe)

    left, right = (groups.select("lang", F.col("source").alias(n), F.col("g").alias(g)) for n, g in (("source", "a"), ("item", "b")))
    pairs = left.join(right, "lang").where("a < b").join(found, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    own = cells.join(small(groups.select("lang", "source", "total")), ["lang", "source"])
    over = own.select("lang", "source", F.col("term").alias("item"), (share("count", "total", "terms") - share("lang_count", "lang_total", "terms")).cast("long").alias("value"))
    term = over.where("value > 0").select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return pair.unionByName(term)


ORACLE_SQL = """WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
k AS (SELECT lang, term, count(*) AS lc FROM d GROUP BY ALL HAVING count(DISTINCT i) >= 30),
kl AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM d SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * kl.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.lc + 5)) // (kl.ln + 5 * kl.v)::HUGEINT AS q
  FROM t JOIN k ON k.lang = t.lang JOIN kl ON kl.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pd AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pd ON pd.lang = a.lang AND pd.source = a.source AND pd.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""
