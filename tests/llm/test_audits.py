"""The filter interaction audit and the source divergence audit against plain Python."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from tessel.llm.audit import filter_audit
from tessel.llm.divergence import billionths, source_divergence

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


def documents(seed, n=120):
    rng = random.Random(seed)
    pool = ["alpha", "beta", "Gamma", "delta,", "été", "Ünder", "x1y", "a-b", "# mark", "UPPER", "ß", "end."]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(pool[: rng.randint(2, len(pool))]) for _ in range(rng.choice([0, 3, 199, 200, 230])))
        rows.append((i, rng.choice([text, text + " tail", None, "", "\t \n"]), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None, ""])))
    rows += [(1000 + i, rows[i][1], *rows[n - 1 - i][2:]) for i in range(30)]  # copies in other groups
    rows += [rows[5], rows[5], (None, rows[7][1], "en", "s1"), (None, rows[7][1], "en", "s1")]
    return rows


def plain_filters(rows, labels):
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, x in labels if x == 1} - {None}
    judged = defaultdict(list)
    for d, t, _, s in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        judged[s or ""].append(({f for f, x in fails.items() if x}, d in good, d in toxic))
    out = []
    for part, docs in judged.items():
        total = Counter()
        mine = []
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                fail = sum(f in x[0] for x in docs)
                mine.append([part, "".join(order), k + 1, len(left), len(gone), fail - len(gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone), f])
        out += [tuple(r[:-1]) + (total[r[-1]],) for r in mine]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_filter_audit_equals_all_orders_applied(spark, seed):
    rows, rng = documents(seed), random.Random(seed)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    found = filter_audit(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, found.collect())) == plain_filters(rows, labels)


def test_filter_audit_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "en", "s"), (2, None, None, None)], DOCS)
    labels = spark.createDataFrame([], LABELS)
    extra = docs.selectExpr("*", "doc_id AS mask", "doc_id AS part", "doc_id AS n", "doc_id AS text_key", "doc_id AS quality")
    found = filter_audit(extra, labels.selectExpr("*", "doc_id AS n", "doc_id AS part"))
    assert sorted(map(tuple, found.collect())) == plain_filters([tuple(r) for r in docs.collect()], [])
    assert filter_audit(docs.limit(0), labels).count() == 0


def plain_divergence(rows, least, top):
    def found(t):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]

    held, counts, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source in rows:
        ts = found(t)
        held[lang or ""].update(set(ts))
        whole[lang or ""].update(ts)
        counts[(lang or "", source or "")].update(ts)
    out = []
    for (lang, source), own in counts.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        p, q = shares(own), shares(whole[lang])
        pair = [(s, sum(abs(p[t] - x) for t, x in shares(c).items())) for (la, s), c in counts.items() if la == lang and s != source]
        term = [(t, p[t] - q[t]) for t in kept if own[t] and p[t] > q[t]]
        for part, items, most in (("pair", pair, None), ("term", term, top)):
            out += [(lang, source, part, i, x, k + 1) for k, (i, x) in enumerate(sorted(items, key=lambda r: (-r[1], r[0].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "stripe"), [(16, 2048, 8), (1, 2, 1), (2, 3, 2)])
def test_source_divergence_equals_plain_sums(spark, block, chunk, stripe):
    rows = documents(3)
    found = source_divergence(spark.createDataFrame(rows, DOCS).repartition(5), least=8, top=3, block=block, chunk=chunk, stripe=stripe)
    assert sorted(map(tuple, found.collect())) == plain_divergence(rows, 8, 3)


def test_source_divergence_of_odd_tables(spark):
    rows = [(1, "Word\x00word_WORD été " * 50_000, "en", "a"), (2, None, "en", "b"), (3, "only", "de", None), (4, "", None, "c"), (5, None, "en", "b")]
    docs = spark.createDataFrame(rows, DOCS)
    extra = docs.selectExpr("*", "doc_id AS term", "doc_id AS count", "doc_id AS g", "doc_id AS item", "doc_id AS rank")
    for least in (1, 30):
        assert sorted(map(tuple, source_divergence(extra, least=least).collect())) == plain_divergence(rows, least, 50)
    assert source_divergence(docs.limit(0)).count() == 0


def test_billionths_are_exact_for_large_sums():
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        total = rng.randrange(10**15)
        count, v = rng.randrange(total + 1), rng.randrange(1, 10**6)
        assert int(billionths(np.array([count]), np.array([total]), v)[0]) == 1 + 10**9 * (count + 5) // (total + 5 * v)
