"""Near duplicates, decontamination and sharding against plain restatements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessel.llm import decontam, neardup, sharding
from tessel.llm._shared import materialize


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_components(texts, n, threshold=80):
    sets, parent = [shingles(t, n) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "one", "One", "two words", "a b c", "A b C", "x " * 50]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):  # chains of edits: neighbours are near, ends are not
            base = [rng.choice(vocab) if rng.random() < 0.03 else w for w in base]
            texts.append(" ".join(base) if rng.random() < 0.8 else "\n".join(base).upper())
    group = [rng.choice(vocab) for _ in range(150)]
    for _ in range(40):
        texts.append(" ".join(rng.choice(vocab) if rng.random() < 0.025 else w for w in group))
    rng.shuffle(texts)
    return texts + [texts[3]]


@pytest.mark.parametrize("seed,n", [(0, 2), (1, 5), (2, 2)])
def test_near_duplicates(spark, seed, n):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash", True) for i, t in enumerate(texts)], "doc_id long, text string, component_id string, kept boolean")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, n=n).collect()}
    for i, (size, root) in enumerate(plain_components(texts, n)):
        r = got[i]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (size, root, root == i), (i, texts[i])


@pytest.mark.parametrize("seed", [4, 7])
def test_one_bucket_for_all(spark, seed):
    """Every pair has to be found beside the one hub."""
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = materialize(neardup.signatures(docs, 2, 1, 1), "signed").where("digest is not null")
    classes = signed.groupBy("digest").agg(F.min("n_shingles").alias("n_shingles"), F.min("text_key").alias("text_key"))
    classes = materialize(classes.select("*", F.monotonically_increasing_id().alias("node"), F.array(F.lit(0).cast("long")).alias("bands")), "classes")
    roots = {r["node"]: r["root"] for r in neardup.link_classes(classes, docs, 2, 80).collect()}
    node = {r["doc_id"]: r["node"] for r in signed.select("doc_id", "digest").join(classes, "digest").collect()}
    groups = {}
    for d, x in node.items():
        groups.setdefault(roots.get(x, x), []).append(d)
    got = {d: min(g) for g in groups.values() for d in g}
    assert [got.get(i, i) for i in range(len(texts))] == [r for _, r in plain_components(texts, 2)]


def test_drop_near_duplicates(spark, tmp_path):
    texts = corpus(5)
    rows = [(i // 2 if i < 8 else i, t, "de", "s", 1, "c") for i, t in enumerate(texts)] + [(None, "alone text here", "x", "s", 1, "c")] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, row string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = neardup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    roots = {r for _, r in plain_components(texts, 5)}
    assert out.count() == len(roots) + 1
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def normal(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_contained(docs, items, n=5):
    out = set()
    for d, t in enumerate(docs):
        w = normal(t)
        for i, x in enumerate(items):
            v = normal(x)
            k = min(n, len(v))
            if not k:
                continue
            own = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if 100 * len(own & have) >= 80 * len(own):
                out.add((d, i, len(own), len(own & have)))
    return out


@pytest.mark.parametrize("block", [50_000, 3])
def test_decontamination(spark, block):
    rng = random.Random(3)
    vocab = [f"v{i}é" for i in range(200)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [text(k) for k in (6, 14, 30, 59, 120, 4, 2, 1)] + [None, "", "...", "the the the the the the"]
    docs = [None, "", text(500), "one"]
    for x in items[:8]:
        docs += [text(300) + " " + x.upper() + ". " + text(200), text(5) + ", " + " ".join(x.split()[: max(1, len(x.split()) * 9 // 10)]), " ".join(w if rng.random() > 0.06 else "z" for w in x.split())]
    docs += [items[3]] * 2 + ["the " * 50]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = {tuple(r) for r in decontam.contained_items(d, b, block_items=block).collect()}
    want = plain_contained(docs, items)
    assert got == want and len(want) > 15
    clean = decontam.drop_contaminated(d, b, block_items=block)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(docs))) - {x[0] for x in want} and clean.columns == d.columns
    assert decontam.contained_items(d.where("false"), b).count() == 0 and decontam.contained_items(d, b.where("false")).count() == 0


def test_least_hits():
    assert decontam.least_hits(0.8) > 1 and decontam.least_hits(1.0) == decontam.COORDINATES


@pytest.mark.parametrize("rows,hot", [(0, 0), (1, 0), (15, 3), (500, 0), (501, 200), (64, 64)])
def test_sharding(spark, rows, hot):
    rng = random.Random(rows)
    texts = ["hot"] * hot + [rng.choice([None, "", f"g{i % 37}", f"é{i}"]) for i in range(rows - hot)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, shard string").repartition(3)
    got = sharding.sharding_digest(docs).collect()
    assert len(got) == rows and len({r["doc_id"] for r in got}) == rows
    slots = {s: [] for s in range(16)}
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == __import__("zlib").crc32((t or "").encode()) and r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if rows == 500:  # groups of 13 gather in a few of 16 shards, where chance would spread them over nine
        groups = {}
        for r in got:
            if (texts[r["doc_id"]] or "").startswith("g"):
                groups.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        assert sum(map(len, groups.values())) < 3 * len(groups)


@pytest.mark.parametrize("loose", [800, 0])
def test_sharding_gathers_small_groups(spark, loose):
    """Pairs and triples end in one shard; without loose rows, those beyond a shard's exact share may be cut."""
    texts = [f"p{i}" for i in range(200) for _ in range(2)] + [f"t{i}" for i in range(200) for _ in range(3)] + [f"u{i}" for i in range(loose)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    shards, rows = {}, [0] * 16
    for r in sharding.shard_documents(docs).collect():
        shards.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        rows[r["shard"]] += 1
    cut = sum(len(s) > 1 for s in shards.values())
    assert max(rows) - min(rows) <= 1 and cut <= (4 if loose else 80), cut


def test_drop_near_duplicates_when_the_scan_changes(spark, tmp_path):
    """Other file splits at the end than while judging leave the same rows."""
    for i in range(16):
        rows = [(10 * i + j, "the same words in each of these many files" if j == i % 3 else f"only {i} and {j} stand in this row w{i} v{j}") for j in range(3 + i % 4)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    copies = docs.where("text like 'the same words%'").count()
    out = neardup.drop_near_duplicates(docs)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        kept = [r["text"] for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert copies == 16 and len(kept) == docs.count() - 15 and sum(t.startswith("the same") for t in kept) == 1


def test_batches_beyond_a_slice(spark):
    """More text in one partition than a task takes at once, with capitals throughout."""
    rng = random.Random(9)
    vocab = [f"Word{i}" for i in range(3000)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(14_000)]
        texts += [" ".join(base), " ".join(base).upper(), " ".join(rng.choice(vocab) if rng.random() < 0.03 else w for w in base), " ".join(rng.choice(vocab) if rng.random() < 0.2 else w for w in base)]
    rng.shuffle(texts)
    assert 2 * sum(map(len, texts)) > 4 << 20
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, n=2).collect()}
    want = plain_components(texts, 2)
    assert got == {i: want[i % len(texts)] for i in range(2 * len(texts))}
