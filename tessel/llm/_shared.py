"""Helpers of the training-data operators: shared scratch tables and batched tokenisation."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words that one Python worker remembers; later words are encoded anew each batch.
MEMO_WORDS = 50_000


_LOCAL_ROOTS: dict[str, str] = {}
#: Bytes of a written table up to which it may be broadcast; beyond, the join is shuffled.
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch between Spark and Python while a table is written; the session's own value holds again after.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir; where that is unset, a local folder in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="tessel-")
        root = _LOCAL_ROOTS[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tessel-{uuid.uuid4().hex[:12]}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of materialize() that nothing reads any more: what follows from them has to be written already."""
    for table in tables:
        if path := getattr(table, "_scratch", None):
            spark = table.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its files hold few bytes (by Spark's own statistics, without a job)."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def pieces_of(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Parts of a batch whose text holds about `limit` bytes at most (one longer text stays whole).

    A part is a copy with arrays of its own, since some of pyarrow's string functions go wrong on slices.
    """
    col = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.take(pa.array(np.arange(lo, hi))) if lo or hi < len(sizes) or col.offset else batch
        lo = hi


def ragged_take(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of pool[starts[i] : starts[i] + lengths[i]]."""
    ends = np.cumsum(lengths, dtype=lengths.dtype)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(starts - (ends - lengths), lengths)
    index += np.arange(total, dtype=index.dtype)
    return pool[index]


#: Words whose pre-tokens the patterns below give exactly; all others take the library's whole path.
_PLAIN = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*")
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z\u00DF-\u00F6\u00F8-\u00FF0-9]+")


def _byte_alphabet() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class BatchEncoder:
    """Token ids of whole text columns by the tokenizers library.

    The vocabulary's pre-tokeniser never joins characters across ASCII white space, so a text's ids are those of its
    space-separated words in order. Words repeat, so each distinct word of a batch is looked up once. Words not seen
    before are split into pre-tokens, and each new pre-token goes through the library's model; a word with anything
    but ASCII and Latin-1 letters (or with a special token's string) goes through the whole tokenizer.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {b"": b""}
        self.parts: dict[str, bytes] = {}
        self.memo_words = memo_words
        self.alphabet = _byte_alphabet()
        self.plain = self._is_plain()

    def _is_plain(self) -> bool:
        """Whether the shorter path gives this vocabulary's ids on probes; else every word takes the whole path."""
        probes = ["Hello,", "don't", "ÀÉß.###", "a1b22", "I'LL", "x'dé!!", "THE''s", "_a_b", "ÿöØ"]
        return all(self._word(w) == self._whole(w) for w in probes)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)
            found = np.array([t.id for t in self.model.tokenize(shown)], dtype="<u4").tobytes()
            if len(self.parts) < self.memo_words:
                self.parts[part] = found
        return found

    def _word(self, word: str) -> bytes:
        return b"".join(map(self._part, _PRE_TOKEN.findall(word.lower())))

    def _new(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8")
        ids = self._word(word) if self.plain and _PLAIN.fullmatch(word) and "<|" not in word else self._whole(word)
        if len(self.words) < self.memo_words:
            self.words[raw] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy().astype(np.int64)
        flat = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        del words, texts
        bounds -= bounds[0]
        codes, uniq = flat.indices.to_numpy(), flat.dictionary
        at = np.frombuffer(uniq.buffers()[1], dtype=np.int64)[uniq.offset : uniq.offset + len(uniq) + 1].tolist()
        data = uniq.buffers()[2].to_pybytes() if at and at[-1] else b""
        get, new = self.words.get, self._new
        known = []
        for a, b in zip(at, at[1:]):
            raw = data[a:b]
            ids = get(raw)
            known.append(new(raw) if ids is None else ids)
        size = np.fromiter(map(len, known), dtype=np.int32, count=len(known)) // 4
        pool = np.frombuffer(b"".join(known), dtype="<u4")
        del known, data, flat, uniq
        starts = (np.cumsum(size, dtype=np.int64) - size).astype(np.int32)
        lengths = size[codes]
        parts = [ragged_take(pool, starts[c], size[c]) for c in np.array_split(codes, len(codes) // 1_000_000 + 1)] if len(codes) else []
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return np.concatenate(parts) if parts else pool[:0], np.diff(total[bounds])


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """The worker's encoder for a vocabulary file; it is kept between the tasks of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
