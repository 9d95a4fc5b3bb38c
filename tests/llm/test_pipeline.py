"""The chain of stages against plain restatements, and the language network's accuracy on held-out documents."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import decontam, langid, quality, secrets
from tests.llm.test_duplicates import plain_components, plain_contained
from tests.llm.test_text_scans import plain_quality


def prose(rng, n, vocab):
    return " ".join(rng.choice(vocab) + ("." if i % 9 == 8 else "") for i in range(n))


def test_chain(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("aeiourstlnmdc") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    texts = [None, "", "too short", "word " * 90, "# $ % & " * 40, "LOUD WORDS " * 40]
    good = [prose(rng, rng.randint(60, 300), vocab) for _ in range(40)]
    items = [prose(rng, 40, vocab) for _ in range(4)]
    for t in good[:12]:
        w = t.split(" ")
        texts += [t, " ".join([*w[:-1], "changed"])] if rng.random() < 0.6 else [t] * 3
    texts += [t + " " + items[i % 4] + " " + good[-1 - i] for i, t in enumerate(good[12:18])]
    texts += [t + " password=hunter2hunter2 and more" for t in good[18:24]] + good[24:] + [prose(rng, 9000, vocab)]
    rng.shuffle(texts)
    rows = [(i, t, "xx", "s", len(t or ""), "own", True) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, n_words string, kept boolean").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate([*items, None, items[0]])), "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {}
    for i, t in enumerate(texts):
        n_words, chars, symbols, dup, repeated = plain_quality(t)
        letters, upper = len(re.findall(r"[^\W\d_]", t or "")), len(re.findall("[A-Z]", t or ""))
        lines = [x for x in (t or "").split("\n") if x.strip()]
        if n_words >= 50 and repeated * 100 <= 50 * n_words and symbols * 100 <= 10 * chars and upper * 100 <= 50 * letters and letters * 100 > 50 * chars and dup * 100 <= 60 * len(lines):
            left[i] = t
    ids = sorted(left)
    roots = plain_components([left[i] for i in ids], 5)
    groups = {}
    for i, (_, r) in zip(ids, roots):
        groups.setdefault(r, []).append(i)
    firsts = [min(g) for g in groups.values()]
    held = {firsts[d] for d, *_ in plain_contained([left[i] for i in firsts], items)}
    want = {i: re.sub(r"password=\S+", "[SECRET]", left[i]) for i in firsts if i not in held}
    assert 0 < len(want) < len(firsts) < len(ids) < len(texts)

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns and {r["n_words"] for r in after.collect()} == {"own"}, name
        docs = after
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == want

    from tokenizers import Tokenizer

    from tessel.llm._shared import default_tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {d: sum((x for _, x in sorted(p)), []) for d, p in pieces.items()} == {d: tokenizer.encode(t, add_special_tokens=False).ids + [1] for d, t in want.items()}


def test_stages_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, "x")], "item_id smallint, text string")
    assert quality.keep_good(empty).count() == 0 and secrets.redact_secrets(empty).count() == 0
    assert decontam.drop_contaminated(empty, items).count() == 0
    assert decontam.contained_items(spark.createDataFrame([("a", "x y"), ("a", "x")], "doc_id string, text string"), items).collect()[0]["item_id"] == 1


def test_quality_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "w0", "l0")], "doc_id long, text string, w string, lines string")
    got = quality.quality_cascade(docs).first()
    assert (got["w"], got["lines"], got["n_words"], got["kept"]) == ("w0", "l0", 3, False)


SENTENCES = {
    "en": "the river runs through the old town and nobody knows where the water comes from when it rains".split(),
    "de": "der fluss läuft durch die alte stadt und niemand weiß woher das wasser kommt wenn es regnet".split(),
    "fr": "la rivière traverse la vieille ville et personne ne sait d'où vient l'eau quand il pleut".split(),
}


def test_language(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        lang = list(SENTENCES)[i % 3]
        rows.append((i, " ".join(rng.choice(SENTENCES[lang]) for _ in range(rng.randint(6, 60))), lang if i % 5 else None, lang, "clash"))
    rows += [(900, None, "en", None, "x"), (901, "", "de", None, "x"), (902, "123 ... 456", "fr", None, "x"), (903, "der " * 40000, "de", "de", "x"), (None, "the river", None, None, "x"), (5, rows[5][1], rows[5][2], rows[5][3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, score string").repartition(3)
    got = langid.identify(docs, steps=120).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (900, 901, 902)) and by_id[903]["lang_pred"] == "de"
    held = [(r[0], r[3]) for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert {r["doc_id"] for r in got if r["held_out"]} == {d for d, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 3 == 1}
    assert np.mean([by_id[d]["lang_pred"] == lang for d, lang in held]) > 0.95
    assert len({r["lang_pred"] for r in got if r["doc_id"] == 5}) == 1  # copies are judged alike
    # what is held out teaches nothing
    blind = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("zz")).otherwise(F.col("lang")))
    again = {r["doc_id"]: r["lang_pred"] for r in langid.identify(blind, steps=120).collect()}
    assert again == {d: r["lang_pred"] for d, r in by_id.items()}
    assert langid.identify(docs.where("false")).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gradients():
    """Backpropagation through time against differences of the loss."""
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in langid._init(3, 4, rng).items()}
    x, y = rng.integers(97, 110, (7, 5)), rng.integers(0, 3, 5)
    x[5:, 2] = langid.PAD
    _, grad = langid._gradients(w, x, y)
    for k in w:
        at = np.unravel_index(np.argmax(np.abs(grad[k])), grad[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        slope = (langid._gradients(up, x, y)[0] - langid._gradients(down, x, y)[0]) / 2e-3
        assert abs(slope - grad[k][at]) < 2e-2 * abs(slope) + 1e-4, k
