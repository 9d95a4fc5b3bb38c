"""Secret scans: fixed patterns and dictionary-primed compression novelty.

Base kinds are found leftmost and non-overlapping: `assign`, `access`, `hex`. Further, each long string of letters or
digits that follows a sensitive word is a candidate: zstandard, primed with a dictionary of identifiers, compresses
the text around it with and without it, and the candidate is reported (`novel`) where its marginal bytes are at least
NOVELTY of its length, since a random secret hardly compresses and a known identifier does. A candidate of letters
alone (or digits alone) may be joined words, so its marginal bytes after fixed prose must be at least WORDLESS of its
length too; random letters of one case often stay below that.

The dictionary is learnt from the documents: the IDENTIFIER_PARTS word parts that stand in most of them (ties by
name), counted over all whole texts, after a few fixed identifiers. Candidates in a sensitive context are left out of
the counts, so that a secret with many copies never primes the dictionary that it is judged by.

Then each document is judged alone: memory for one slice of a batch; only counts are shuffled. Null texts are empty and
have no span; very long texts are scanned whole; repeated rows are scanned each; an empty table gives no row; extra
columns are ignored by scan_secrets and kept by redact_secrets.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._shared import discard, materialize, pieces_of

KINDS = ("assign", "access", "hex", "novel")
#: Marginal compressed bytes per character from which a candidate is reported, and the compression level: a high one
#: also finds the short matches that identifiers are made of, so that random strings stand apart.
NOVELTY, LEVEL = 0.68, 15
#: The same, after PROSE, for a candidate without a letter or without a digit: words stay below, random strings don't.
WORDLESS = 0.85
#: Characters of context before and after a candidate.
BEFORE, AFTER = 256, 128
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
HEX = re.compile(r"[0-9a-f]{32,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
SEPARATOR = re.compile(r"[:=]")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
DIGIT = re.compile(r"[0-9]")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"(?:secret|token|passw|pwd|credential|private|bearer|auth|api.?key|access.?key|signature)[^\n]{0,24}\Z", re.I | re.A)
#: A part of an identifier or a word; a longer run of letters is none.
PART = re.compile(r"(?<![a-z])[A-Z]?[a-z]{3,14}(?![a-z])")
#: Word parts in the dictionary, and those that a task counts before it passes them on.
IDENTIFIER_PARTS, HELD_PARTS = 3_000, 100_000
#: Identifiers that often stand in code and settings.
IDENTIFIERS = (
    "access_token refresh_token id_token token_type bearer authorization authentication client_id client_secret api_key "
    "apikey private_key public_key secret_key access_key session_id user_id request_id password_hash credentials "
    "configuration environment connection_string database_url localhost example.com https:// http:// version "
    "application/json content-type utf-8 function return import class const static void string integer boolean "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000000000000000000000000000"
)
#: Prose whose letter frequencies a word fits and a random string doesn't.
PROSE = (
    "The service reads its settings from a file and connects to the network before it starts. Each request carries a header "
    "with the name of the client, and the answer holds the status, the content and a short message for the user. When a session "
    "ends, the manager removes what is no longer needed and writes a line to the log. Administrators can change the permissions of "
    "every account, review recent activity and restore a previous version. Please keep this information private, do not share it "
    "with anyone outside the department, and contact support if something looks wrong with your registration or your payment. "
)


def assign_spans(text: str) -> list[tuple[int, int]]:
    """ASSIGN's leftmost non-overlapping matches with a value of 8 characters or more.

    A match has its separator right after a keyword, so only separators are looked at: the keyword must end there,
    and a match that an earlier one overlaps doesn't count.
    """
    out, end = [], 0
    for sep in SEPARATOR.finditer(text):
        at = sep.start()
        if at < end:
            continue
        while at > end and text[at - 1] == " ":
            at -= 1
        if at > end and text[at - 1] in "\"'":
            at -= 1
        tail = text[max(end, at - 8) : at].lower()
        for word in KEYWORDS:
            if tail.endswith(word) and (m := ASSIGN.match(text, at - len(word))):
                if len(m[2]) >= 8:
                    out.append((m.start(), m.end()))
                end = m.end()
                break
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the base kinds, in order."""
    found = [(a, 0, b) for a, b in assign_spans(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def sensitive_candidates(text: str) -> list[tuple[int, int]]:
    """Candidates that follow a sensitive word."""
    spans = (m.span() for m in CANDIDATE.finditer(text))
    return [(a, b) for a, b in spans if SENSITIVE.search(text[max(0, a - 48) : a])]


def parts_of(text: str) -> set[str]:
    """Word parts of a text, its candidates in a sensitive context left out."""
    found, end = set(), 0
    for a, b in sensitive_candidates(text):
        found.update(PART.findall(text[end:a]))
        end = b
    found.update(PART.findall(text[end:] if end else text))
    return found


def learn_identifiers(docs: DataFrame, parts: int = IDENTIFIER_PARTS) -> str:
    """The dictionary's content: fixed identifiers, then the word parts found in most documents, the commonest last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                for text in batch.column("text").to_pylist():
                    held.update(parts_of(text or ""))
                if len(held) > HELD_PARTS:
                    yield pa.record_batch([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["part", "n"])
                    held.clear()
        if held:
            yield pa.record_batch([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["part", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "part string, n long")
    counts = materialize(counts.groupBy("part").agg(F.sum("n").alias("n")), "parts")
    level = F.floor(F.log2("n") * 16)  # counts within a few per cent of each other
    least, found = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # about a thousand rows at most
        least, found = r["level"], found + r["count"]
        if found >= parts:
            break
    best = counts.where(level >= least).orderBy(F.desc("n"), "part").limit(parts).collect()
    discard(counts)
    return " ".join([IDENTIFIERS, *(r["part"] for r in reversed(best))])


class Novelty:
    """Marginal compressed size of strings in their context."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = LEVEL):
        import zstandard

        def primed(content: str, level: int) -> zstandard.ZstdCompressor:
            dictionary = zstandard.ZstdCompressionDict(content.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False)

        self.compressor = primed(identifiers, level)
        self.plain = primed(IDENTIFIERS, 3)  # PROSE stands for words here: its letters must not come from the dictionary
        self.prose = len(self.plain.compress(PROSE.encode()))

    def marginal(self, text: str, start: int, end: int) -> float:
        """Bytes that text[start:end] adds to its context, per character."""
        before, after = text[max(0, start - BEFORE) : start].encode(), text[end : end + AFTER].encode()
        own = text[start:end].encode()
        with_it = len(self.compressor.compress(before + after + own))
        return (with_it - len(self.compressor.compress(before + after))) / len(own)

    def wordless(self, own: str) -> float:
        """Bytes that a string adds to PROSE, per character."""
        return (len(self.plain.compress((PROSE + own).encode())) - self.prose) / len(own)

    def spans(self, text: str, threshold: float = NOVELTY) -> list[tuple[int, int, int]]:
        out = []
        for a, b in sensitive_candidates(text):
            own = text[a:b]
            if self.marginal(text, a, b) >= threshold:
                if DIGIT.search(own) and re.search("[A-Za-z]", own) or self.wordless(own) >= WORDLESS:
                    out.append((a, 3, b))
        return out


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, threshold: float = NOVELTY, identifiers: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for documents (doc_id, text).

    identifiers is the dictionary's content; without it, it is learnt from these documents.
    """
    known = learn_identifiers(docs) if identifiers is None else identifiers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                rows = []
                for text in batch.column("text").to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    more = novelty.spans(text, threshold)
                    n = [sum(k == i for _, k, _ in base) for i in range(3)]
                    rows.append((*n, hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(sorted(base + more))))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", threshold: float = NOVELTY, identifiers: str | None = None) -> DataFrame:
    """docs with every span of `text` replaced by a mark (overlapping spans by one); other columns stay as they are."""
    schema = docs.schema
    at = docs.columns.index("text")
    known = learn_identifiers(docs) if identifiers is None else identifiers

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                out = []
                for text in batch.column("text").to_pylist():
                    if text:
                        parts, end = [], 0
                        for a, _, b in sorted(base_spans(text) + novelty.spans(text, threshold)):
                            if a >= end:
                                parts += [text[end:a], mark]
                            end = max(end, b)
                        text = "".join([*parts, text[end:]]) if parts else text
                    out.append(text)
                yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(redact, schema)
