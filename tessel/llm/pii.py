"""Personal data by weak supervision.

Regex, gazetteer, context and shape labelers vote (for, against, abstain) on candidate spans of all documents. The
counts of vote patterns over the whole corpus, a table bounded by 3^labelers rows, go into expectation maximisation,
which estimates the labelers' reliabilities without labels. Its posteriors are the soft targets of a logistic span
classifier, trained on at most TRAIN_SPANS candidates; its verdict adds spans of the kinds ssn, local_phone, name and
number to the base kinds email, ip, card and phone, which always stay.

The gazetteers of names and mail endings are learnt: words that follow a title, and endings of addresses, in at least
GAZETTEER_DOCUMENTS documents, of these the GAZETTEER_WORDS most frequent (all candidates are counted), beside a few
fixed ones. A name that is found once is no evidence against it: its labeler abstains.

Each text is read once: candidates are written to a shared table, where the model then judges them. Null texts are
empty and have no span; very long texts are scanned whole, each at once; repeated rows are scanned each; an empty table
gives no row; extra columns are ignored. Ties (of sampled spans' hashes and of gazetteer words' counts) go by doc_id,
place and kind, and by the word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._shared import discard, materialize, pieces_of

KINDS = ("email", "ip", "card", "phone", "ssn", "local_phone", "name", "number")
BASE = 4
#: Candidate spans that the classifier is trained on at most, drawn by hash from all documents' candidates.
TRAIN_SPANS = 20_000
#: Documents in which a name or ending stands to be learnt, and the number of learnt words of each kind at most.
GAZETTEER_DOCUMENTS, GAZETTEER_WORDS = 2, 20_000
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9][0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+)-])(?<!\+[0-9] )\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20[A-Z][a-zà-ÿ]+(?:\x20[A-Z][a-zà-ÿ]+)?")
CUE = re.compile(r"\b(?:phone|tel|mobile|call|fax|e-?mail|contact|ssn|social security|passport|card|visa|iban|account|ip|address|born|name)\b[^\n]{0,24}\Z", re.I | re.A)
COUNTER_CUE = re.compile(r"\b(?:version|isbn|order|build|figure|page|chapter|line|sum|total|rev)\b[^\n]{0,12}\Z", re.I | re.A)
#: Mail domains' endings, card issuers' first digits, calling codes and given names of the gazetteers.
MAIL_ENDINGS = frozenset("com org net edu gov de fr es uk eu io info".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
CALLING = ("1", "33", "34", "39", "44", "49", "52", "54", "61", "81", "86", "91")
GIVEN = frozenset("anna ben carlos claire david elena emma hans jean john juan karl laura lucia maria marie mary michael paul peter pierre sarah sofia thomas".split())
LABELERS = ("regex", "gazetteer", "context", "shape", "isolation")
#: Place of the gazetteer's vote among the classifier's features: after the constant, the kinds and four more.
GAZETTEER_FEATURE = 1 + len(KINDS) + 4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def email_spans(text: str) -> list[tuple[int, int]]:
    """EMAIL's leftmost non-overlapping matches, looked for at each @ alone: a local part begins at its run's start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append(m.span())
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end): the base spans, then spans only the classifier can admit."""
    out = [(a, 0, b) for a, b in email_spans(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and (len(p) < 4 or not p[:-3].strip("0")) for p in m[0].split("."))]
        rest = []
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
            elif 12 <= len(digits) <= 19:
                rest.append((m.start(), 7, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdecimal, m[0])) <= 15]
        rest += [(m.start(), 4, m.end()) for m in SSN.finditer(text)]
        rest += [(m.start(), 5, m.end()) for m in LOCAL_PHONE.finditer(text)]
        taken = sorted((a, b) for a, _, b in out)
        ends = [b for _, b in taken]
        for a, k, b in rest:  # what a base span overlaps is no candidate
            i = np.searchsorted(ends, a, side="right")
            if i == len(taken) or taken[i][0] >= b:
                out.append((a, k, b))
    out += [(m.start(), 6, m.end()) for m in NAME.finditer(text)]
    return sorted(out)


def gazetteer_words(text: str, start: int, kind: int, end: int) -> list[str]:
    """What a gazetteer may know of a span: a name's words after the title, an address's ending."""
    span = text[start:end].lower()
    return span.split()[1:] if kind == 6 else [span.rsplit(".", 1)[-1]] if kind == 0 else []


def votes_and_features(text: str, start: int, kind: int, end: int) -> tuple[list[int], list[float]]:
    """The labelers' votes (1 for, -1 against, 0 abstain) and the classifier's features of one span."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = text[max(0, start - 48) : start]
    known = gazetteer_words(text, start, kind, end)
    regex = 1 if kind < BASE or kind == 4 or kind == 6 and len(known) > 1 else 0
    if kind == 0:
        gazetteer = 1 if known[0] in MAIL_ENDINGS else 0
    elif kind in (2, 7):
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    elif kind == 3:
        gazetteer = 1 if digits.startswith(CALLING) else -1
    elif kind == 6:
        gazetteer = 1 if any(w in GIVEN for w in known) else 0
    else:
        gazetteer = 0
    context = 1 if CUE.search(before) else -1 if COUNTER_CUE.search(before) else 0
    if kind in (2, 7):
        shape = 1 if len(digits) in (15, 16) and luhn(digits) else -1
    elif kind == 4:
        shape = -1 if digits[:3] in ("000", "666") or digits[0] == "9" else 1
    else:
        shape = -1 if digits and len(set(digits)) == 1 else 1 if kind in (0, 1, 3) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    isolation = -1 if left.isalnum() or right.isalnum() or left in ("/", "_", "#") and left else 1
    votes = [regex, gazetteer, context, shape, isolation]
    features = [1.0, *(float(kind == k) for k in range(len(KINDS))), min(len(span), 40) / 40, len(digits) / max(1, len(span)), float(context == 1), float(context == -1), float(gazetteer == 1), float(isolation == 1), float(luhn(digits) if digits else 0)]
    return votes, features


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior, reliability table [class, labeler, vote], posterior of each pattern) of two hidden classes.

    patterns holds votes in -1..1. Labelers are taken as independent given the class; each vote's rates are smoothed.
    """
    score = patterns.sum(1)
    post = np.clip(0.5 + 0.2 * score, 0.05, 0.95)
    n = patterns.shape[1]
    table, prior = np.zeros((2, n, 3)), 0.5
    for _ in range(steps):
        weight = np.stack([(1 - post) * counts, post * counts])
        prior = float(np.clip(weight[1].sum() / counts.sum(), 0.01, 0.99))
        for vote in (-1, 0, 1):
            table[:, :, vote + 1] = weight @ (patterns == vote) + 1.0
        table /= table.sum(2, keepdims=True)
        like = np.log([1 - prior, prior])[:, None] + sum(np.log(table[:, j, :])[:, patterns[:, j] + 1] for j in range(n))
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return prior, table, post


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model with soft targets y, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


CANDIDATES = "array<struct<start:int,kind:int,end:int,pattern:int,features:array<float>,words:array<string>>>"


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32()), ("features", pa.list_(pa.float32())), ("words", pa.list_(pa.string()))])


def extract_candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidate spans, with the labelers' votes (as a base-3 number) and features."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, "text"):
                out = []
                for text in batch.column("text").to_pylist():
                    found = []
                    for a, k, b in candidates(text or ""):
                        votes, features = votes_and_features(text, a, k, b)
                        found.append({"start": a, "kind": k, "end": b, "pattern": sum((v + 1) * 3**i for i, v in enumerate(votes)), "features": features, "words": gazetteer_words(text, a, k, b)})
                    out.append(found)
                yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.list_(SPAN))], names=["doc_id", "found"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found {CANDIDATES}")


def learn_gazetteer(found: DataFrame, documents: int = GAZETTEER_DOCUMENTS, words: int = GAZETTEER_WORDS) -> dict[int, frozenset[str]]:
    """Each kind's words that stand in enough documents' candidates; the most frequent, and of equals the first by letters."""
    each = found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.kind", F.explode("s.words").alias("word")).distinct()
    counted = each.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= documents)
    return {k: frozenset(r["word"] for r in counted.where(F.col("kind") == k).orderBy(F.desc("c"), "word").limit(words).collect()) for k in (0, 6)}


def with_gazetteer(found: DataFrame, gazetteer: dict[int, frozenset[str]]) -> DataFrame:
    """Candidates whose gazetteer labeler abstained, but that hold a learnt word, get its vote."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column("found").to_pylist():
                for s in spans or ():
                    if not s["features"][GAZETTEER_FEATURE] and any(w in gazetteer.get(s["kind"], ()) for w in s["words"]):
                        s["features"][GAZETTEER_FEATURE] = 1.0
                        s["pattern"] += 3 ** LABELERS.index("gazetteer")
                out.append(spans)
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.list_(SPAN))], names=["doc_id", "found"])

    return found.mapInArrow(vote, found.schema)


def train(found: DataFrame, train_spans: int = TRAIN_SPANS) -> np.ndarray | None:
    """The span classifier's weights from all candidates' vote patterns and a bounded sample; None without candidates."""
    spans = found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*")
    counted = spans.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3^5 rows
    if not counted:
        return None
    codes = np.array([r["pattern"] for r in counted])
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(LABELERS))], axis=1)
    _, _, post = expectation_maximisation(patterns, np.array([r["count"] for r in counted], dtype=float))
    if (post * (patterns[:, 0] == 1)).sum() < ((1 - post) * (patterns[:, 0] == 1)).sum():
        post = 1 - post  # the classes come without names: the one that strict patterns vote for is personal data
    posterior = dict(zip(codes.tolist(), post))
    sample = spans.orderBy(F.xxhash64("doc_id", "start", "kind"), "doc_id", "start", "kind").limit(train_spans).select("pattern", "features").collect()
    return fit_logistic(np.array([r["features"] for r in sample], dtype=float), np.array([posterior[r["pattern"]] for r in sample]))


def find_pii(docs: DataFrame, train_spans: int = TRAIN_SPANS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for documents (doc_id, text)."""
    seen = materialize(extract_candidates(docs), "candidates")
    found = materialize(with_gazetteer(seen, learn_gazetteer(seen)), "labelled")
    discard(seen)
    weights = train(found, train_spans)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in batch.column("found").to_pylist():
                base, more = [], []
                for s in found or ():
                    if s["kind"] < BASE:
                        base.append((s["start"], s["kind"], s["end"]))
                    elif weights is not None and float(np.dot(weights, s["features"])) > 0:
                        more.append((s["start"], s["kind"], s["end"]))
                n = [sum(k == i for _, k, _ in base) for i in range(BASE)]
                rows.append((*n, hashlib.sha256(_shown(sorted(base)).encode()).hexdigest(), _shown(sorted(base + more))))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(judge, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
