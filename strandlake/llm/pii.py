"""Personal data: fixed patterns, and a skip-chain conditional random field.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers by pattern. The field labels tokens (runs
without white space) with a kind or none. Its chain links neighbours; skip links join a token to the next one in the
document that reads the same or much the same, however far: equal letters and digits, equal last seven or first six
digits, or an equal part before `@`. So repeated and altered mentions share potentials. Loopy message passing gives each
token's marginal: a round sweeps the text forward and backward, and sends the messages of chain and skip links on its way,
so that evidence travels the whole text in one round; rounds repeat until the messages stand still. Confident tokens
outside base spans become spans: mentions that no pattern matches, but that repeat one that does.

Only tokens with a digit, `@` or `+` have evidence. A run of other tokens has constant potentials, so its message is a
power of one matrix and costs one step however long it is; texts without such a token have no spans. The field is
fitted piecewise in a bounded sample (about TRAIN_DOCS documents of up to DOC_TOKENS tokens with evidence, TRAIN_TOKENS
in all): a softmax over token shapes, and the association of label pairs on neighbours and on skip links. Its labels are
those of the base, and, after each sampled text, its values written in another way (labelled) and other values written
like that (not labelled). So a shape that no pattern matches is unclear by itself, and the links decide. Features are
made on the executors; the driver receives the sample's features, never texts.

Defined results: a null text is empty and has no spans; repeated rows are scanned alike; without labels to learn from
only the base finds spans; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_TOKENS, DOC_TOKENS = 4000, 20_000, 500
#: The least belief of an added span where lessons can't tell a kind's own.
CONFIDENT = 0.9
#: For a kind's own: the share of held-out mentions under its cut's upper side, of other tokens above its lower side, and
#: the fewest mentions that tell it; parts that lessons are split into, each judged by a field fitted to the others.
MOST_MENTIONS, OTHERS, FEWEST, PARTS = 0.1, 0.002, 8, 2
#: Most rounds of message passing; they end when no message changes by CHANGE.
ROUNDS, CHANGE = 20, 1e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EVIDENCE = re.compile(r"[0-9@+]")
_TRIM = ".,;:!?()[]{}<>\"'"
_LABELS = len(KINDS) + 1
UNKNOWN = -1
_LONGEST_RUN = 64

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    """Each `@` with the longest local part before it that the last match left; linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, leftmost and not overlapping within a kind, by start and then kind."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _bucket(n: int, bounds: tuple[int, ...]) -> int:
    return sum(n >= b for b in bounds)


_COUNTS = (1, 2, 3, 4, 5, 9, 12, 16, 20)


def _shape(token: str) -> list[tuple]:
    """What the field sees of a token."""
    core = token.strip(_TRIM)
    digits = "".join(_DIGIT.findall(core))
    parts = core.split(".")
    return [
        ("spelled", _plain(token) != token),
        ("at", core.count("@") == 1 and bool(_DOMAIN.search(core)), "@" in core),
        # How many digits and dots an address has says nothing about it.
        ("digits", "address") if "@" in core else ("digits", _bucket(len(digits), _COUNTS), core == digits),
        ("luhn", 12 <= len(digits) <= 19 and core.replace("-", "") == digits and luhn(digits)),
        ("quad", len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)),
        ("plus", "address") if "@" in core else ("plus", token.startswith("+"), _bucket(len(digits), (1, 9, 16))),
        ("marks", "address") if "@" in core else ("marks", "(" in token or ")" in token, "-" in core, len(parts) > 1),
        ("letters", any(map(str.isalpha, core))),
    ]


def evidence(text: str) -> tuple[list[re.Match], list[int], list[list[tuple]]]:
    """Tokens with evidence, the number of plain tokens before each, and their features."""
    tokens, gaps, shapes, plain = [], [], [], 0
    for m in _TOKEN.finditer(text):
        if _EVIDENCE.search(m[0]):
            tokens.append(m), gaps.append(plain), shapes.append(_shape(m[0]))
            plain = 0
        else:
            plain += 1
    features = []
    for i, own in enumerate(shapes):
        before = shapes[i - 1][1] if i and not gaps[i] else ("none",)
        after = shapes[i + 1][1] if i + 1 < len(shapes) and not gaps[i + 1] else ("none",)
        features.append([*own, ("before", *before), ("after", *after)])
    return tokens, gaps, features


#: Marks of addresses spelled out in brackets. Fixed values.
_SPELLED = [(re.compile(r"[(\[{<](?:at|AT|At)[)\]}>]"), "@"), (re.compile(r"[(\[{<](?:dot|DOT|Dot)[)\]}>]"), ".")]


def _plain(token: str) -> str:
    """A token with spelled-out marks as marks."""
    if not any(c in token for c in "([{<"):
        return token
    for pattern, mark in _SPELLED:
        token = pattern.sub(mark, token)
    return token


def _keys(token: str) -> set[tuple[str, str]]:
    """What similar tokens have in common."""
    token = _plain(token)
    same, digits = "".join(filter(str.isalnum, token)).lower(), "".join(_DIGIT.findall(token))
    keys = {("same", same)} if len(same) >= 4 else set()
    if len(digits) >= 7:
        keys |= {("last", digits[-7:]), ("first", digits[:6])} if len(digits) >= 12 else {("last", digits[-7:])}
    local = token.lstrip(_TRIM).partition("@")
    return keys | {("local", local[0].lower())} if local[1] and len(local[0]) >= 3 else keys


def links(tokens: list[re.Match]) -> list[tuple[int, int]]:
    """Skip links: each token with the last one before it that has a key in common, by each key once."""
    last: dict[tuple[str, str], int] = {}
    out = []
    for i, m in enumerate(tokens):
        keys = _keys(m[0])
        out += sorted({(last[k], i) for k in keys if k in last})
        last.update(dict.fromkeys(keys, i))
    return out


def gold(tokens: list[re.Match], spans: list[Span]) -> list[int]:
    """Labels of the base: the kind of the first span that touches a token, or 0."""
    out, k = [], 0
    ordered = sorted(spans, key=lambda s: s[1])
    for m in tokens:
        while k < len(ordered) and ordered[k][2] <= m.start():
            k += 1
        out.append(KINDS.index(ordered[k][0]) + 1 if k < len(ordered) and ordered[k][1] < m.end() else 0)
    return out


def _association(pairs: np.ndarray) -> np.ndarray:
    """Joint over independent probability of label pairs, symmetrically smoothed."""
    joint = pairs + 1.0
    joint /= joint.sum()
    return joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))


Lesson = tuple[list[list[tuple]], list[int], list[int], list[tuple[int, int]]]
Sample = tuple[Lesson, list[Lesson]]


class Field:
    """The fitted potentials, and inference over a document."""

    def __init__(self, documents: list[Lesson]):
        """documents: features, labels, gaps and links of each."""
        self.cuts = np.full(len(KINDS), CONFIDENT)
        self.index: dict[tuple, int] = {}
        rows, labels = [], []
        chain, skip = np.zeros((_LABELS, _LABELS)), np.zeros((_LABELS, _LABELS))
        for features, own, gaps, joined_by in documents:
            rows += [[self.index.setdefault(f, len(self.index)) for f in x] for x, label in zip(features, own, strict=True) if label != UNKNOWN]
            labels += [label for label in own if label != UNKNOWN]
            for i in range(1, len(own)):
                if UNKNOWN in own[i - 1 : i + 1]:
                    continue
                if gaps[i]:
                    chain[own[i - 1], 0] += 1
                    chain[0, 0] += gaps[i] - 1
                    chain[0, own[i]] += 1
                else:
                    chain[own[i - 1], own[i]] += 1
            for i, j in joined_by:
                if UNKNOWN not in (own[i], own[j]):
                    skip[own[i], own[j]] += 1
                    skip[own[j], own[i]] += 1
        self.known = sorted(set(labels) - {0})
        self.weights = self._softmax(rows, np.array(labels, np.int64))
        step = _association(chain)
        through = np.zeros((_LABELS, _LABELS))
        through[0, 0] = 1.0  # a plain token has no label
        self.runs = [step]
        for _ in range(_LONGEST_RUN):
            x = self.runs[-1] @ through @ step
            self.runs.append(x / x.max())
        # Over the shares of the labels among all tokens, as links are rare and join what is labelled more often than not.
        joint, share = (skip + 1.0) / (skip + 1.0).sum(), np.bincount(labels, minlength=_LABELS) + 1.0
        share /= share.sum()
        self.skip = joint / (share[:, None] * share)
        self.skip /= self.skip.max()

    def _softmax(self, rows: list[list[int]], labels: np.ndarray) -> np.ndarray:
        w = np.zeros((len(self.index) + 1, _LABELS))
        if not rows:
            return w
        x = np.array(rows)
        target = np.eye(_LABELS)[labels]
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, 201):
            z = w[x].sum(1)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = np.zeros_like(w)
            np.add.at(g, x, ((p - target) / len(x))[:, None, :])
            g += 1e-5 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        return w

    def marginals(self, features: list[list[tuple]], gaps: list[int], joined_by: list[tuple[int, int]]) -> np.ndarray:
        """Label probabilities by loopy message passing, in sweeps over chain and skip links alike."""
        n = len(features)
        z = np.array([self.weights[[self.index.get(f, -1) for f in x]].sum(0) for x in features])
        own = np.exp(z - z.max(1, keepdims=True))
        own /= own.sum(1, keepdims=True)
        right, left = np.ones((2, len(joined_by), _LABELS))
        before: list[list[int]] = [[] for _ in range(n)]
        after: list[list[int]] = [[] for _ in range(n)]
        for k, (i, j) in enumerate(joined_by):
            after[i].append(k), before[j].append(k)
        steps = [self.runs[min(g, _LONGEST_RUN)] for g in gaps]
        local, forward, backward, belief = own.copy(), np.ones((n, _LABELS)), np.ones((n, _LABELS)), own.copy()

        def meet(i: int) -> np.ndarray:
            x = own[i] * right[before[i]].prod(0) * left[after[i]].prod(0) if before[i] or after[i] else own[i]
            local[i] = x / x.sum()
            y = forward[i] * local[i] * backward[i]
            belief[i] = y / y.sum()
            return belief[i]

        for _ in range(ROUNDS):
            change = 0.0
            for i in range(n):
                if i:
                    x = (forward[i - 1] * local[i - 1]) @ steps[i]
                    forward[i] = x / x.sum()
                b = meet(i)
                for k in after[i]:
                    x = (b / left[k]) @ self.skip
                    x /= x.sum()
                    change = max(change, float(np.abs(x - right[k]).max()))
                    right[k] = x
            for i in range(n - 1, -1, -1):
                if i < n - 1:
                    x = steps[i + 1] @ (backward[i + 1] * local[i + 1])
                    backward[i] = x / x.sum()
                b = meet(i)
                for k in before[i]:
                    x = self.skip @ (b / right[k])
                    left[k] = x / x.sum()
            if change < CHANGE:
                break
        return belief

    def calibrate(self, held: list[tuple[Field, list[Lesson]]]) -> Field:
        """Sets the least belief of each kind by lessons that the fields before them were not fitted to.

        The lessons are probes, in which a token with a label is an altered mention. The cut lies between the beliefs of most mentions and those of nearly all other tokens, in odds; where the
        two overlap, or under FEWEST mentions are there, a kind keeps the cut of CONFIDENT.
        """
        mentions, others = [[] for _ in KINDS], [[] for _ in KINDS]
        for field, lessons in held:
            for features, labels, gaps, joined_by in lessons:
                if not any(x > 0 for x in labels):
                    continue
                belief = field.marginals(features, gaps, joined_by)
                for i, label in enumerate(labels):
                    if label == UNKNOWN:
                        continue
                    kind = int(belief[i, 1:].argmax())
                    if not label:
                        others[kind].append(belief[i, 1 + kind])
                    else:
                        mentions[label - 1].append(belief[i, label] if kind == label - 1 else 0.0)
        odds = lambda p: np.log(max(p, 1e-6) / max(1 - p, 1e-6))
        for k in range(len(KINDS)):
            if len(mentions[k]) < FEWEST:
                continue
            high = float(np.quantile(mentions[k], MOST_MENTIONS))
            low = float(np.quantile(others[k], 1 - OTHERS)) if others[k] else 0.0
            if high > low:
                self.cuts[k] = 1 / (1 + np.exp(-(odds(high) + odds(low)) / 2))
        return self

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans with those that the field adds where no base span is touched."""
        base = base_spans(text)
        if not self.known or not _EVIDENCE.search(text):
            return base, base
        tokens, gaps, features = evidence(text)
        joined_by = links(tokens)
        belief = self.marginals(features, gaps, joined_by)
        own = gold(tokens, base)
        more: list[Span] = []
        last = -2
        best = belief[:, 1:].argmax(1)
        for i in np.flatnonzero(belief[np.arange(len(best)), 1 + best] >= self.cuts[best]).tolist():
            kind, token = KINDS[best[i]], tokens[i]
            core = token[0].strip(_TRIM)
            if own[i] or not core:
                continue
            a = token.start() + token[0].index(core)
            if last == i - 1 and not gaps[i] and more[-1][0] == kind:
                more[-1] = (kind, more[-1][1], a + len(core))
            else:
                more.append((kind, a, a + len(core)))
            last = i
        return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Forms of `rewritten`.
FORMS = 2


def rewritten(kind: str, value: str, form: int = 0) -> str:
    """A value of a kind in one of FORMS forms that the patterns don't match."""
    if form:
        return value.replace("@", "(at)") if kind == "email" else value.replace(".", ",") if kind == "ip" else ("/" if kind == "card" else ".").join(re.findall("[0-9]{1,4}", value) if kind == "phone" else re.findall("[0-9]{1,4}", "".join(_DIGIT.findall(value))))
    if kind == "email":
        return value.partition(".")[0] if "@" in value.partition(".")[0] else value.partition("@")[0] + "@" + value.partition("@")[2].partition(".")[0]
    digits = "".join(_DIGIT.findall(value))
    if kind == "phone":
        return f"{digits[-7:-4]}-{digits[-4:]}"
    return "-".join(value.split(".")) if kind == "ip" else ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _unlike(value: str) -> str:
    """Another value of the same form."""
    return "".join(str((int(c) * 3 + 7 * i + 4) % 10) if c.isdigit() and c.isascii() else chr(97 + (ord(c) * 7 + i + 3) % 26) if c.isalpha() else c for i, c in enumerate(value))


def lesson(text: str, forms: tuple[int, ...] = tuple(range(FORMS)), probe: bool = False) -> Lesson:
    """Features, labels, gaps and links of a text with its values rewritten, and others like them, after its end.

    In a probe only what is rewritten counts as a mention, so that it tells how far one altered mention is believed.
    """
    spans = base_spans(text)
    known = []
    for kind, value in dict.fromkeys((k, text[a:b]) for k, a, b in spans):
        for k in forms:
            form = rewritten(kind, value, k)
            text += " and "
            known.append((kind, len(text), len(text) + len(form)))
            text += f"{form} or {rewritten(kind, _unlike(value), k)} also"
    found, gaps, features = evidence(text)
    labels, base = gold(found, known + spans), gold(found, spans)
    # A token without a label that repeats one with a label may be what the patterns miss: it teaches nothing, and links
    # are those that the tokens have without it.
    unknown = _unknown(found, labels)
    sure = [i for i in range(len(found)) if i not in unknown]
    joined_by = [(sure[i], sure[j]) for i, j in links([found[i] for i in sure])]
    if probe:
        unknown |= {i for i, label in enumerate(base) if label}
    return features, [UNKNOWN if i in unknown else x for i, x in enumerate(labels)], gaps, joined_by


def sample_of(text: str) -> Sample:
    """What a text teaches, and its probes: one for each form, as a document holds one altered mention more often than all."""
    return lesson(text), [lesson(text, (k,), True) for k in range(FORMS)]


def _unknown(tokens: list[re.Match], labels: list[int]) -> set[int]:
    """Tokens without a label that have a key of one with a label."""
    named = {k for m, label in zip(tokens, labels, strict=True) if label for k in _keys(m[0])}
    return {i for i, (m, label) in enumerate(zip(tokens, labels, strict=True)) if not label and _keys(m[0]) & named}


def learn(df: DataFrame, docs: int = TRAIN_DOCS, tokens: int = TRAIN_TOKENS, text: str = "text") -> Field:
    """Fits the field to a bounded sample of documents that have evidence."""
    rows = df.select("doc_id", text).where(F.col(text).rlike("[0-9@+]"))
    total = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 20)) < min(1.0, docs / max(1, total)) * (1 << 20))

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lessons = [(i, x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len((x := sample_of(t))[0][1]) <= DOC_TOKENS]
            blobs = [pickle.dumps(x) for _, x in lessons]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in lessons], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "lesson"])

    sample, seen = [], 0
    found = picked.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(taught, "doc_id long, lesson binary")
    for r in found.orderBy(F.xxhash64("doc_id"), "lesson").limit(docs).toLocalIterator():
        x = pickle.loads(r["lesson"])
        if seen + len(x[0][1]) <= tokens:
            seen += len(x[0][1])
            sample.append(x)
        if seen >= tokens:
            break
    return taught_by(sample)


def taught_by(sample: list[Sample]) -> Field:
    """A field fitted to all lessons, with cuts from the probes of parts of them under fields fitted to the other parts."""
    parts = [sample[k::PARTS] for k in range(PARTS)]
    held = [(Field([x for j, part in enumerate(parts) if j != k for x, _ in part]), [p for _, probes in own for p in probes]) for k, own in enumerate(parts)]
    return Field([x for x, _ in sample]).calibrate(held)


def scanned(field: Field, text: Column, spark: SparkSession) -> Column:
    """A struct column: counts of base spans, their digest, and all spans."""
    shared = spark.sparkContext.broadcast(field)
    names = [f"n_{k}" for k in KINDS]

    @F.arrow_udf(", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string")
    def run(texts: pa.Array) -> pa.Array:
        counts, digests, spans = [[] for _ in KINDS], [], []
        for t in texts.to_pylist():
            base, every = shared.value.spans(t or "")
            for n, kind in zip(counts, KINDS, strict=True):
                n.append(sum(k == kind for k, _, _ in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        return pa.StructArray.from_arrays([*(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], [*names, "base_sha256", "spans"])

    return run(text)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.withColumn("_s", scanned(learn(docs), F.col("text"), spark)).select("doc_id", "_s.*")
