"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

The base finds assignments, access keys and hexadecimal runs by pattern. The method adds spans: the credentials that the
base labels in a bounded sample of documents are read as strings of character classes into a prefix tree, one for each
kind, whose statistically compatible states are merged (the Hoeffding test of the ALERGIA algorithm). Another automaton
is inferred from unlabelled long tokens. These are no certain negatives, as credentials that the base misses are among
them: it is inferred first from the half that is least like a credential, and then again from all tokens but those found.
Every candidate token of every text is then scored by the likelihood of its format: the best credential automaton against
the ordinary one, in nats a character. The threshold lies halfway between the outer fence of the ordinary scores (three
quartile ranges over the third quartile, 0 at least) and the least twentieth of held-out labelled credentials; where
these don't stand apart, it is the fence and a margin. No single token sets it. As two formats can both be strange to the
ordinary automaton, a credential automaton must also explain the token about as well as it does held-out credentials.

Defined results: a null text is empty and has no spans; repeated rows are scanned alike; without labelled credentials
only the base finds spans; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents

KINDS = ("assign", "access", "hex")
LEARNED = "learned"
#: Documents sampled for training, distinct tokens kept of each kind, and the longest token learned from.
TRAIN_DOCS, TRAIN_TOKENS, TRAIN_CHARS = 20_000, 400, 200
MARGIN = 0.1
#: By how much a token may fit the credential automata worse than the least twentieth of held-out credentials does.
FIT = 0.5
#: One labelled credential in so many is held out of the automata, in kinds that have that many; rounds of the ordinary one.
HELD_OUT, ROUNDS = 5, 5
MASK = "[SECRET]"

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_.=-]{10,})[A-Za-z0-9=]")
_CLASS = {c: ("d" if c.isdigit() else "a" if c in "abcdef" else "A" if c in "ABCDEF" else "z" if c.islower() else "Z" if c.isupper() else c) for c in map(chr, range(33, 127))}
_SIZE = {"d": 10, "a": 6, "A": 6, "z": 20, "Z": 20}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, leftmost and not overlapping within a kind, by start and then kind.

    Runs of one class are matched at their full length, so asking for the least length in the pattern finds what
    filtering all runs would. Assignments can't be matched so: a short one still uses up its text.
    """
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def apart(text: str, spans: list[Span]) -> Iterator[re.Match]:
    """Candidate tokens that touch no span; spans are in order of start, so one sweep over both suffices."""
    at, end = 0, 0  # the greatest end of the spans that start before the candidate's end
    for m in _CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][1] < m.end():
            end = max(end, spans[at][2])
            at += 1
        if end <= m.start():
            yield m


def values(text: str) -> list[tuple[str, str]]:
    """Labelled credentials and ordinary long tokens (kind '') of a text."""
    spans, out = base_spans(text), []
    for kind, a, b in spans:
        out.append((kind, text[a:b] if kind != "assign" else _ASSIGN.match(text, a)[2]))
    return out + [("", m[0]) for m in apart(text, spans)]


class Automaton:
    """A probabilistic automaton over character classes, inferred by state merging from a prefix tree."""

    def __init__(self, tokens: list[str], alpha: float = 0.05):
        self.count, self.final, self.next = [0], [0], [{}]
        for token in tokens:
            at = 0
            self.count[0] += 1
            for c in token:
                step = self.next[at].get(_CLASS[c])
                if step is None:
                    step = self.next[at][_CLASS[c]] = [len(self.count), 0]
                    self.count.append(0), self.final.append(0), self.next.append({})
                step[1] += 1
                at = step[0]
                self.count[at] += 1
            self.final[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()
        self._weigh()

    def _differs(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        stack, seen = [(a, b)], set()
        while stack:
            a, b = stack.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            if self._differs(self.final[a], self.count[a], self.final[b], self.count[b]):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differs(x[1] if x else 0, self.count[a], y[1] if y else 0, self.count[b]):
                    return False
                if x and y:
                    stack.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the subtree at b to the states reached from a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for c, (child, n) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += n
                    stack.append((self.next[a][c][0], child))
                else:
                    self.next[a][c] = [child, n]

    def _infer(self) -> None:
        red = [0]
        while True:
            fixed = set(red)
            blue = [(s, c) for s in red for c, (child, _) in self.next[s].items() if child not in fixed]
            if not blue:
                break
            s, c = max(blue, key=lambda x: (self.count[self.next[x[0]][x[1]][0]], -x[0], x[1]))
            child = self.next[s][c][0]
            target = next((r for r in red if self._compatible(r, child)), None)
            if target is None:
                red.append(child)
            else:
                self.next[s][c][0] = target
                self._fold(target, child)

    def _weigh(self) -> None:
        """Logarithms of smoothed probabilities; a missing step costs as a rare character and returns to the start."""
        self.rare = math.log(1e-4)
        self.step = [{c: (child, math.log(n / self.count[s]) - math.log(_SIZE.get(c, 1))) for c, (child, n) in self.next[s].items()} for s in range(len(self.count))]
        self.end = [math.log((self.final[s] + 0.01) / (self.count[s] + 0.02)) for s in range(len(self.count))]

    def likelihood(self, token: str) -> float:
        """Nats a character, the end included."""
        at, total = 0, 0.0
        for c in token:
            at, x = self.step[at].get(_CLASS[c], (0, self.rare))
            total += x
        return (total + self.end[at]) / (len(token) + 1)


def _quantile(sorted_values: list[float], share: float) -> float:
    return sorted_values[int(share * (len(sorted_values) - 1))]


def _threshold(ordinary: list[float], held: list[float]) -> float:
    """From the scores of unlabelled tokens, of which up to a quarter may be credentials, and of held-out credentials."""
    ordinary, fence = sorted(ordinary), 0.0
    if ordinary:
        low, high = _quantile(ordinary, 0.25), _quantile(ordinary, 0.75)
        fence = max(0.0, high + 3 * (high - low))
    least = _quantile(sorted(held), 0.05)
    return (fence + least) / 2 if least > fence + 2 * MARGIN else fence + MARGIN


class Detector:
    """The automata of all kinds and the score from which a candidate is a secret."""

    def __init__(self, tokens: dict[str, list[str]]):
        self.kinds, held = [], []
        for k in KINDS:
            if found := tokens.get(k):
                apart = found[::HELD_OUT] if len(found) >= HELD_OUT else []
                self.kinds.append(Automaton([t for i, t in enumerate(found) if not apart or i % HELD_OUT]))
                held += apart or found
        self.ordinary, self.threshold, self.least_fit = None, math.inf, math.inf
        if not self.kinds:
            return
        self.least_fit = _quantile(sorted(map(self.fit, held)), 0.05) - FIT
        mixed = tokens.get("") or []
        usual = sorted(mixed, key=lambda t: (self.fit(t), t))[: (len(mixed) + 1) // 2]
        for _ in range(ROUNDS):
            self.ordinary = Automaton(usual) if usual else None
            self.threshold = _threshold([*map(self.score, mixed)], [*map(self.score, held)])
            before, usual = usual, [t for t in mixed if not self.found(t)]
            if set(before) == set(usual):
                break

    def fit(self, token: str) -> float:
        return max((a.likelihood(token) for a in self.kinds), default=-math.inf)

    def found(self, token: str) -> bool:
        return self.fit(token) >= self.least_fit and self.score(token) > self.threshold

    def score(self, token: str) -> float:
        if not self.kinds:
            return -math.inf
        usual = self.ordinary.likelihood(token) if self.ordinary else math.log(1 / 68)
        return self.fit(token) - usual

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans with the learned ones that touch no base span."""
        base = base_spans(text)
        more = []
        if self.kinds:
            more = [(LEARNED, m.start(), m.end()) for m in apart(text, base) if self.found(m[0])]
        return base, sorted(base + more, key=lambda s: (s[1], (*KINDS, LEARNED).index(s[0]))) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def learn(df: DataFrame, docs: int = TRAIN_DOCS, tokens: int = TRAIN_TOKENS, text: str = "text") -> Detector:
    """Infers the automata from a bounded sample: about `docs` documents, and `tokens` distinct tokens of each kind."""
    rows = df.select("doc_id", text).where(F.col(text).isNotNull())
    total = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("secrets")), F.lit(1 << 20)) < min(1.0, docs / max(1, total)) * (1 << 20))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {v for t in batch.column(0).to_pylist() for v in values(t) if len(v[1]) <= TRAIN_CHARS}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["kind", "token"])

    found = picked.select(text).mapInArrow(label, "kind string, token string").distinct()
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.xxhash64("token"), "token"))
    sample: dict[str, list[str]] = {}
    for r in found.withColumn("_rank", rank).where(F.col("_rank") <= tokens).orderBy("kind", "_rank").collect():
        sample.setdefault(r["kind"], []).append(r["token"])
    return Detector(sample)


def scanned(detector: Detector, text: Column, spark: SparkSession) -> Column:
    """A struct column: counts of base spans, their digest, and all spans."""
    shared = spark.sparkContext.broadcast(detector)

    @F.arrow_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(texts: pa.Array) -> pa.Array:
        counts, digests, spans = [[], [], []], [], []
        for t in texts.to_pylist():
            base, every = shared.value.spans(t or "")
            for n, kind in zip(counts, KINDS, strict=True):
                n.append(sum(k == kind for k, _, _ in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        columns = [*(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run(text)


def redacted(detector: Detector, text: Column, spark: SparkSession) -> Column:
    """The text with every secret masked; null stays null."""
    shared = spark.sparkContext.broadcast(detector)

    def mask(t: str) -> str:
        out, at = [], 0
        for _, a, b in shared.value.spans(t)[1]:
            if b > at:
                out += [t[at:a], MASK] if a >= at else []
                at = b
        return "".join([*out, t[at:]])

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else mask(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.withColumn("_s", scanned(learn(docs), F.col("text"), spark)).select("doc_id", "_s.*")
