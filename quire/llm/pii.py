"""Personal data by weak supervision.

Four kinds of spans are defined by fixed patterns (email, ip, card, phone) and are found as
such. Beyond them, candidates (values that look like secrets, and cards and phone numbers that
a longer run of digits hides from the patterns) are judged by several weak labelers: shapes
given by regular expressions, a gazetteer of names that secrets go by, and the context around
the candidate. Each votes yes, no or not at all. Expectation-maximisation over the counts of
vote patterns in the whole corpus estimates how reliable every labeler is for either class, and
with that how likely each candidate is private. A logistic classifier over the votes and over the
span itself (kind, length, variety and kind of its characters, what stands around it) is then
trained on these probabilities, and its verdict adds the spans. A card must pass its check sum.

Only counts of patterns reach the driver: there are at most kinds x 3^labelers x 4^4
of them, whatever the corpus, and they cover all of it, so nothing is sampled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import per_batch, slices

#: Kinds in the order of output; the last is only found by the method.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
#: Names that secrets go by, in lower case.
GAZETTEER = frozenset(
    "password passwd pwd passphrase passcode secret token key apikey api_key access_key secret_key auth authorization bearer credential credentials pin".split()
)
#: Beginnings of well-known access keys.
KEY_STARTS = ("AKIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "xoxp-", "glpat-")
LABELERS = 5
#: Characters of a pattern before the votes.
SHAPE = 5

# The patterns of the contract, in forms that take linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_VALUE = re.compile(r"(?<![A-Za-z0-9_./+-])(?=[A-Za-z_./+-]*+[0-9])[A-Za-z0-9_./+-]{8,}+")
_STRICT_CARD = re.compile(r"(?<![0-9])[0-9]{16}(?![0-9])")
_STRICT_PHONE = re.compile(r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])")
_HEX = re.compile(r"[0-9a-f]{12,}|[0-9A-F]{12,}")
_KEY_BEFORE = re.compile(r"""([A-Za-z][A-Za-z_-]{0,30})["']?\s{0,3}[=:]\s{0,3}["']?$""")
_PLAIN = re.compile(r"(?=.*[a-z]{4})(?=.*[g-z]).*|[0-9.+/-]+", re.DOTALL)

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; each @ is looked at once, with the run of letters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the four fixed kinds, by kind, then start; code points."""
    found = [(EMAIL, s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((CARD, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((PHONE, m.start(), m.end()))
    return found


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that spans cover, ascending."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def touches(covered: tuple[list[int], list[int]], s: int, e: int) -> bool:
    """Whether a span shares a character with one of the intervals."""
    at = bisect_left(covered[0], e)
    return at > 0 and covered[1][at - 1] > s


def candidates(text: str, base: list[Span]) -> Iterator[tuple[Span, tuple[int, ...]]]:
    """Further spans that may be private, apart from the base ones, with the labelers' votes (1, -1, 0)."""
    spans = [(s, e) for _, s, e in base]
    known = found = merged(spans)
    new: list[Span] = []
    for kind, pattern in ((CARD, _STRICT_CARD), (PHONE, _STRICT_PHONE), (SECRET, _VALUE)):
        if kind == SECRET and new:
            found = merged(spans + [(s, e) for _, s, e in new])
        for m in pattern.finditer(text):
            s, e = m.span()
            if kind == SECRET:
                if m[0].isdigit() and not _KEY_BEFORE.search(text[max(0, s - 40) : s]):
                    continue  # a number, unless it is given a name
                e -= len(m[0]) - len(m[0].rstrip(".-+/"))
            if touches(found if kind == SECRET else known, s, e) or (kind == CARD and not luhn(m[0])):
                continue
            new.append((kind, s, e))
    for kind, s, e in new:
        value, before = text[s:e], text[max(0, s - 40) : s]
        named = _KEY_BEFORE.search(before)
        listed = named is not None and named[1].lower().replace("-", "_") in GAZETTEER
        if kind == SECRET:
            shape = 1 if _HEX.fullmatch(value) or value.startswith(KEY_STARTS) else -1
            mixed = len(value) >= 12 and len(set(value)) >= 7 and any(c.isalpha() for c in value)
            context = 1 if named else -1 if before[-1:].isspace() or not before else 0
            plain = -1 if shape < 0 and _PLAIN.fullmatch(value) else 0
        else:
            shape, plain = 1, 0
            mixed = len(set(value)) >= 6
            context = 1 if not (before[-1:].isalnum() or text[e : e + 1].isalnum()) else -1
        gazetteer = 1 if listed or value.startswith(KEY_STARTS) or (kind == CARD and value[0] in "3456") else 0
        yield (kind, s, e), (shape, 1 if mixed else -1, gazetteer, context, plain)


def pattern_of(span: Span, votes: tuple[int, ...], text: str) -> str:
    """What the model sees of a candidate: kind, classes of its length, of how many different
    characters it has, of what they are and of what stands around it; then the votes."""
    kind, s, e = span
    value = text[s:e]
    variety = min(3, 4 * len(set(value)) // (min(len(value), 16) + 1))
    made_of = 0 if value.isdigit() else 1 if value.isalnum() and (value.islower() or value.isupper()) else 2 if value.isalnum() else 3
    around = 2 * (s > 0 and not text[s - 1].isspace()) + (e < len(text) and not text[e].isspace())
    return f"{kind}{min(3, len(value) // 12)}{variety}{made_of}{around}" + "".join("n0y"[v + 1] for v in votes)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each vote pattern is private, and (class, labeler, vote) reliabilities.

    Every labeler votes on its own given the class. A prior worth a few votes says that
    labelers are right more often than not, which also fixes which class is which.
    """
    prior = np.array([[0.60, 0.28, 0.12], [0.12, 0.28, 0.60]]) * 12.0  # class x (no, none, yes)
    seen = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    private = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    for _ in range(rounds):
        both = np.stack([1 - private, private]) * counts
        share = (both.sum(axis=1) + 1) / (both.sum() + 2)
        reliable = np.einsum("cp,plv->clv", both, seen) + prior[:, None, :]
        reliable /= reliable.sum(axis=2, keepdims=True)
        odds = np.log(share)[:, None] + np.einsum("plv,clv->cp", seen, np.log(reliable))
        private = 1 / (1 + np.exp(np.clip(odds[0] - odds[1], -50, 50)))
    return private, reliable


def features(pattern: str) -> list[float]:
    votes = ["n0y".index(c) - 1 for c in pattern[SHAPE:]]
    own = [float(pattern[i] == c) for i in range(1, SHAPE) for c in "0123"]
    return [1.0, *(float(v > 0) for v in votes), *(float(v < 0) for v in votes), *(float(int(pattern[0]) == k) for k in (CARD, PHONE)), *own]


def trained(counts: dict[str, int], steps: int = 400, shrink: float = 1e-3) -> frozenset[str]:
    """The candidate patterns that the span classifier calls private."""
    patterns = sorted(counts)
    if not patterns:
        return frozenset()
    n = np.array([counts[p] for p in patterns], dtype=float)
    private, _ = expectation_maximisation(np.array([["n0y".index(c) - 1 for c in p[SHAPE:]] for p in patterns]), n)
    x, weight = np.array(list(map(features, patterns))), n / n.sum()
    # patterns weigh by the logarithm too, so that rare ones aren't drowned by one frequent kind
    weight = (weight + (logs := np.log1p(n)) / logs.sum()) / 2
    beta = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method would do it in fewer, but may not converge on separable data
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += 4.0 * (x.T @ (weight * (private - p)) - shrink * beta)
    yes = x @ beta > 0
    # whatever the fit, no vote for it means no span
    return frozenset(p for p, y in zip(patterns, yes, strict=True) if y and "y" in p[SHAPE:])


def written(spans: list[Span]) -> str:
    """kind:start:end, comma-joined, by kind as listed, then start."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def fitted(docs: DataFrame, text_col: str = "text") -> frozenset[str]:
    """Counts the vote patterns of all candidates in the corpus and trains the span classifier."""

    def run(batches):
        for b in slices(batches, "text"):
            counts: dict[str, int] = {}
            for text in b.column("text").to_pylist():
                for span, votes in candidates(text, base_spans(text)):
                    p = pattern_of(span, votes, text)
                    counts[p] = counts.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    source = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9]"))
    rows = per_batch(source, run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return trained({r["pattern"]: r["n"] for r in rows})


def found_in(text: str, private: frozenset[str]) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and those that the method adds."""
    base = base_spans(text)
    return base, [span for span, votes in candidates(text, base) if pattern_of(span, votes, text) in private]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The personal data in every whole text.

    Row by row after one pass that fits the classifier: rows and ids may repeat, ids may be
    null, other columns are not read. A null text counts as empty and has no spans; an empty
    table gives an empty result. The counts are those of the base spans.

    Returns (id, n_email, n_ip, n_card, n_phone, base_sha256, spans).
    """
    private = fitted(docs, text_col)

    def run(batches):
        for b in slices(batches, "text"):
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for text in b.column("text").to_pylist():
                base, more = found_in(text, private) if text else ([], [])
                for kind in range(4):
                    counts[kind].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + more))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return per_batch(source, run, schema).withColumnRenamed("id", id_col)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    parts, at, last = [], 0, -1
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"<{KINDS[kind].upper()}>"]
            last = e
        last = max(last, e)
        at = max(at, last)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data masked in the text; null texts stay null."""
    private = fitted(docs, text_col)
    at = docs.columns.index(text_col)
    own = f"c{at}"

    def run(batches):
        for b in slices(batches, own):
            texts = [t and masked(t, sum(found_in(t, private), [])) for t in b.column(own).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    # columns go by their places, since extra ones may have any name
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    source = placed.withColumn(own, F.col(own).cast("string"))
    return per_batch(source, run, source.schema).toDF(*docs.columns)
