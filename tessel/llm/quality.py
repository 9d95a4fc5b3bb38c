"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts come from each whole text, however long. Further rules reject a document each; their cost and selectivity
are measured on a drawn sample, and the cascade runs next the rule with the most rejections per second among the rows that
the base and the rules before it leave (ties by name), so that a rejected document costs no later rule and a rule that
repeats another comes late. The order changes the cost alone, never a verdict. All work stays within a row: no Python, and
no shuffle but of the sample.

The sample is drawn by a hash of the text, about SAMPLE_ROWS rows' share of the distinct texts with their numbers of
copies, so it is the same however the table is cut and a text with very many copies is one row. A rule's cost is the time
of one task that judges the sample many times over, less the same of a rule that does nothing, and the least of ROUNDS
such times.

Null and empty texts have no word and fail the base. Repeated rows are judged each, an empty table gives no row, and
extra columns pass through unless they bear the name of an output column, which replaces them; keep_good passes all
columns through as they are, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm._shared import discard, materialize

#: Rows, on average, of the sample on which costs and selectivities are measured.
SAMPLE_ROWS = 1000
#: Timings of a rule, and characters that the first one judges at least; a rule that ends sooner is given more.
ROUNDS, ROUND_CHARS, ROUND_SECONDS = 2, 1_000_000, 0.1
MIN_WORDS = 50
BLANK = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects`, an expression of the column `text`, is true."""

    name: str
    rejects: Column


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first included.

    Windows are sorted by hash and position; those equal to a neighbour repeat. A word counts once: each repeated
    window adds the words up to the next repeated window's start, three at most.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1), p + 3) - p))
        return F.aggregate(steps, F.lit(0).cast("int"), lambda a, b: a + b)

    def repeats(ranked: Column) -> Column:
        same = F.filter(ranked, lambda s, k: (s["h"] == F.get(ranked, k - 1)["h"]) | (s["h"] == F.get(ranked, k + 1)["h"]))
        return let(F.array_sort(F.transform(same, lambda s: s["i"])), covered)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        ranked = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ranked(h), repeats)))

    return F.when(F.size(words) < 4, 0).otherwise(let(words, windows))


def share_over(count: Column, whole: Column, percent: int) -> Column:
    return count * 100 > whole * percent


def default_rules() -> list[Rule]:
    """Rules on letters, symbols, lines and word lengths, with limits that ordinary prose stays far from."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return [
        Rule("symbols", share_over(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), solid, 10)),
        Rule("shouting", share_over(F.regexp_count(text, F.lit(r"\p{Lu}")), F.regexp_count(text, F.lit(r"\p{L}")), 50)),
        Rule("exclaiming", share_over(F.regexp_count(text, F.lit(r"[!?]{2,}")), words, 40)),
        Rule("few_letters", ~share_over(F.regexp_count(text, F.lit(r"\p{L}")), solid, 50)),
        Rule("same_lines", let(lines_of(text), lambda a: share_over(F.size(a) - F.size(F.array_distinct(a)), F.size(a), 60))),
        Rule("long_words", solid > words * 40),
    ]


def drawn_sample(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, copies: the distinct texts whose hash falls into the sample's share of rows, written in one file."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    own = docs.select("text").where(F.pmod(F.xxhash64(F.lit(2), F.coalesce("text", F.lit(""))), F.lit(1 << 30)) < int(share * (1 << 30)))
    return materialize(own.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).coalesce(1), "sample")


def rule_costs(sample: DataFrame, rules: Sequence[Rule]) -> list[float]:
    """Seconds that each rule takes for the sample once, job and scan apart."""
    held = sample.coalesce(1).agg(F.sum(F.length("text"))).first()[0] or 0

    def timed(rejects: Column, times: int) -> float:
        rows = sample.coalesce(1).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times))))
        began = time.perf_counter()
        rows.agg(F.count_if(rejects & (F.col("again") > 0))).collect()
        return time.perf_counter() - began

    def cost(rejects: Column) -> float:
        times = max(1, ROUND_CHARS // max(1, held))
        while timed(rejects, times) < ROUND_SECONDS + idle(times) and times < 1 << 16:  # also compiles
            times *= 4
        return max(0.0, min(timed(rejects, times) for _ in range(ROUNDS)) - idle(times)) / times

    known: dict[int, float] = {}

    def idle(times: int) -> float:
        if times not in known:
            nothing = F.length("text") < 0
            timed(nothing, 1)
            known[times] = min(timed(nothing, times) for _ in range(ROUNDS))
        return known[times]

    return [cost(r.rejects) for r in rules]


def measure(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds for the sample, share rejected of the rows that come to it), in the order of the cascade."""
    sample = drawn_sample(docs, sample_rows)
    costs = rule_costs(sample, rules)
    passed = quality_features(sample).where("not base_failed")
    mask = sum((F.when(r.rejects, 1 << i).otherwise(0) for i, r in enumerate(rules)), F.lit(0))
    left = {r["mask"]: r["n"] for r in passed.groupBy(mask.alias("mask")).agg(F.sum("copies").alias("n")).collect()}  # of the sample
    discard(sample)
    out, rest = [], list(range(len(rules)))
    while rest:
        total = sum(left.values())
        gone = {i: sum(n for m, n in left.items() if m >> i & 1) for i in rest}
        best = min(rest, key=lambda i: (-gone[i] / max(costs[i], 1e-9), rules[i].name))
        out.append((rules[best], costs[best], gone[best] / total if total else 0.0))
        rest.remove(best)
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return out


def unused(name: str, columns: Sequence[str]) -> str:
    """name, lengthened until no column bears it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def quality_features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = [c for c in docs.columns if c not in out]
    w, lines = unused("w", passed), unused("lines", passed)
    rows = docs.select(*[f"`{c}`" for c in passed], words_of(text).alias(w), lines_of(text).alias(lines))
    rows = rows.select(
        *[f"`{c}`" for c in passed],
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(w)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.withColumn("base_failed", failed)


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """quality_features with kept: neither the base nor a rule rejects."""
    kept = F.when(F.col("base_failed"), False)
    for rule, _, _ in measure(docs, rules or default_rules(), sample_rows):
        kept = kept.when(rule.rejects, False)
    return quality_features(docs.drop("kept")).withColumn("kept", kept.otherwise(True))


def keep_good(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the cascade keeps, with all columns as they are."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return quality_cascade(packed, rules, sample_rows).where("kept").select("row.*")


def quality_digest(docs: DataFrame) -> DataFrame:
    rows = quality_cascade(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
h AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM g),
d AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM d) GROUP BY r),
f AS (SELECT w.r, doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(regexp_extract_all(text, '\p{Lu}')) AS BIGINT) AS upper_letters, CAST(len(regexp_extract_all(text, '\p{L}')) AS BIGINT) AS letters,
  CAST(len(regexp_extract_all(text, '[!?]{2,}')) AS BIGINT) AS cries
  FROM w LEFT JOIN c ON c.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * upper_letters > 50 * letters OR 100 * cries > 40 * n_words
    OR NOT 100 * letters > 50 * word_chars OR 100 * n_dup_lines > 60 * n_lines OR word_chars > 40 * n_words) AS kept
FROM b
"""
