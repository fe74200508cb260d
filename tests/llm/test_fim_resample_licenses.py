"""Fill-in-middle, resampling and license scans against plain versions on hard rows, and on empty tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import fim, licenses, resample

from .conftest import SCHEMA, WORDS

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text):
    return PLAIN_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def lined(hard_rows):
    """The hard rows and texts of lines of every kind."""
    r = random.Random(3)
    rows = [(400 + i, "".join("é" * r.randrange(4) + r.choice(["a b", "", "漢", "\r"]) + "\n" for _ in range(r.randrange(9))) + r.choice(["", "end", "\n\n"]), "en", "s", 1) for i in range(60)]
    rows += [(470 + k, t, "en", "s", 1) for k, t in enumerate(["\n", "\n\n\n", "no break", "has <P> inside\nx", "<S>", "a\n<M>", "< P>", "<P", "x\n" * 50_000])]
    return [*hard_rows, *rows]


def brute_fim(rows):
    out = []
    for i, t, *_ in rows:
        t = t or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        x = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = [int(x[k : k + 8], 16) for k in range(0, 32, 8)]
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        plain = t == "" or any(mark in t for mark in ("<P>", "<S>", "<M>"))
        form = "plain" if plain else "spm" if h[3] % 100 < 50 else "psm"
        output = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        out.append((i, n, form, None if plain else len(p), None if plain else len(m), output, t))
    return out


def test_fim(spark, lined):
    df = spark.createDataFrame(lined, SCHEMA).repartition(4).withColumn("form", F.lit("clash")).withColumn("output", F.lit("clash"))
    want = brute_fim(lined)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert by_id(fim.digests(df)) == sorted(((*w[:5], sha(w[5]), sha(w[6])) for w in want), key=repr)
    made = fim.transform(df)
    assert by_id(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) == sorted((w[:6] for w in want), key=repr)
    assert by_id(fim.restore(made)) == sorted(((w[0], w[6]) for w in want), key=repr)


def test_fim_pieces(spark, lined):
    """The descriptors say where each part of the output lies; nothing is lost and nothing twice."""
    marks = b"<P><S><M>"
    texts = {i: (t or "").encode() for i, t, *_ in lined if i is not None}
    for r in fim.transform(spark.createDataFrame(lined, SCHEMA).where("doc_id is not null")).collect():
        parts = [(texts[r["doc_id"]] if p["buffer"] == fim.TEXT else marks)[p["start"] : p["start"] + p["length"]] for p in r["pieces"]]
        assert b"".join(parts) == r["output"].encode()
        own = sorted((p["start"], p["length"]) for p in r["pieces"] if p["buffer"] == fim.TEXT)
        assert sum(n for _, n in own) == len(texts[r["doc_id"]])


def test_fim_policy(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "'a\nb\nc\n' as text")
    some = fim.Policy(seed=1, cut_percent=30, spm_percent=20, prefix=b"<|pre|>", suffix=b"<|suf|>", middle=b"<|mid|>")
    made = fim.transform(df, some)
    n = {r["form"]: r["count"] for r in made.groupBy("form").count().collect()}
    assert 1300 < n["plain"] < 1500 and 80 < n["spm"] < 160 and 420 < n["psm"] < 540
    assert {r["text"] for r in fim.restore(made, some).collect()} == {"a\nb\nc\n"}


def test_piece_table_cuts():
    whole = fim.Pieces((memoryview(b"abcdef"), memoryview(b"")), [(0, 0, 3), (0, 3, 3)])
    for a in range(7):
        for b in range(7):
            cut = whole.cut(a, b)
            assert cut.render() == b"abcdef" and len(cut.table) == 4 and cut.digest() == whole.digest()
    for order in ((0, 1, 2), (2, 0, 1), (1, 0, 2)):
        assert fim.Pieces(whole.buffers, [(0, k, 1) for k in range(3)]).arrange(order).arrange(fim.inverse(order)).render() == b"abc"


def test_crc_of_spans():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 70_000).astype(np.uint8)
    for distances in (1, 3, 32):
        crc = resample.Crc(distances)
        start = r.integers(0, 60_000, 400)
        end = start + np.r_[np.arange(200), r.integers(0, 9000, 200)] // (1 if distances > 1 else 20)
        assert crc.of(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        assert crc.of(data, np.array([0, 5]), np.array([70_000, 5])).tolist() == [zlib.crc32(data.tobytes()), 0]
        assert len(crc.of(data, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def brute_resample(rows, target, longest=1):
    def buckets(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text, *_ in rows:
        np.add.at(s, buckets(text), 1)
    for text in target:
        np.add.at(t, buckets(text), 1)
    total_s, total_t = s.sum(), t.sum()
    gain = [math.floor(1000 * math.log((b + 1) * (total_s + 10_000) / ((a + 1) * (total_t + 10_000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for i, text, *_ in rows:
        f = buckets(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    fit = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(fit):
        x.append(k + 1 if k < 10 * len(fit) // 100 else None)
    return sorted(((x[0], x[1], x[2], x[3], x[5] if len(x) > 5 else None) for x in out), key=repr)


@pytest.mark.parametrize("longest", [1, 3])
def test_resample(spark, hard, hard_rows, longest):
    r = random.Random(5)
    target = [" ".join(r.choices(WORDS[:20], k=30)) for _ in range(30)] + [None, "", "漢字 mél"]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = by_id(resample.resampled(hard, items, longest=longest).select("doc_id", "n_features", "weight", "score", "rank"))
    assert got == brute_resample(hard_rows, target, longest)


def test_selected(spark, hard, hard_rows):
    items = spark.createDataFrame([(1, hard_rows[3][1])], "item_id long, text string")
    ranks = {r["doc_id"] for r in resample.resampled(hard, items).where("rank is not null").collect()}
    got = resample.selected(hard, items)
    assert got.columns == hard.columns and {r["doc_id"] for r in got.collect()} == ranks - {None}


def test_hot_ranks(spark):
    """One document in most rows, with equal scores: places still run without gaps, over several ranges."""
    scores = spark.range(20_000).selectExpr("if(id % 3 = 0, id, 7) as doc_id", "30L as n_words", "1L as n_features", "0L as weight", "if(id % 3 = 0, id % 5, 9) as score")
    got = sorted((tuple(r) for r in resample.ranked(scores, F.col("n_words") >= 20, 80).select("rank", "score", "doc_id").where("rank is not null").collect()))
    assert [r[0] for r in got] == list(range(1, 16_001))
    assert got == sorted(got, key=lambda r: (-r[1], r[2], r[0]))


NOTICES = {label: text for label, text in licenses.TEMPLATES if label in ("mit", "gpl", "cc-by-nc", "bsd")}


@pytest.fixture(scope="module")
def noticed(hard_rows):
    """Notices whole, cut short, with words lost, changed and put elsewhere, twice, across a tiny text, and phrases."""
    r = random.Random(11)
    rows = list(hard_rows)
    for k, (label, text) in enumerate(sorted(NOTICES.items())):
        w = text.split()
        lost = [x for j, x in enumerate(w) if j % 15]
        bad = [x if j % 4 else "zzz" for j, x in enumerate(w)]
        mixed = w[:]
        r.shuffle(mixed)
        around = lambda x: " ".join(r.choices(WORDS, k=40)) + " " + " ".join(x) + "\n" + " ".join(r.choices(WORDS, k=30))
        for j, x in enumerate((w, lost, bad, mixed, w + lost, w[: len(w) // 2])):
            rows.append((500 + 10 * k + j, around(x), "en", "s", 1))
        rows += [(500 + 10 * k + 6, text.upper(), "en", "s", 1), (500 + 10 * k + 7, " ".join(w[:3]), "en", "s", 1), (500 + 10 * k + 8, text, "en", "s", 1), (500 + 10 * k + 9, " ".join([*w, *r.choices(WORDS, k=2), *w] * 20), "en", "s", 1)]
    rows += [(600, "the MIT license and the (Apache) License; GNU General-Public license mit", "en", "s", 1), (601, "mit license mit license", "en", "s", 1), (602, "mit", "en", "s", 1), (603, "license", "en", "s", 1)]
    return rows


def brute_licenses(rows, templates, containment):
    tables = [(label, words_of(text)) for label, text in templates]
    out = []
    for i, text, *_ in rows:
        w = words_of(text)
        base = sorted((s, label) for label, phrase in licenses.PHRASES.items() for s in range(len(w)) if w[s : s + len(phrase.split())] == phrase.split())
        labels, score = {label for _, label in base}, 1.0 if base else 0.0
        for label, t in tables:
            own = set(t)
            places = [x in own for x in w]
            if sum(places) < math.ceil(containment * len(own) - 1e-9):
                continue
            best = max(len(own & set(w[s : s + len(t)])) for s in range(max(1, len(w) - len(t) + 1)))
            if best >= max(1, math.ceil(containment * len(own) - 1e-9)):
                labels.add(label)
                score = max(score, best / len(own))
        out.append((i, len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("containment", [0.9, 0.5])
def test_licenses(spark, noticed, containment):
    df = spark.createDataFrame(noticed, SCHEMA).repartition(4).withColumn("labels", F.lit("clash")).withColumn("blocks", F.lit("clash"))
    scanner = licenses.learn(df, containment=containment)
    got = by_id(licenses.licensed(df, scanner).drop("blocks"))
    assert got == brute_licenses(noticed, licenses.TEMPLATES, containment)
    if containment == 0.9:
        labels = {r[0]: r[6] for r in got}
        for k, label in enumerate(sorted(NOTICES)):
            assert all(label in labels[500 + 10 * k + j].split(",") for j in (0, 3, 4, 6, 8, 9))
            assert label not in labels[500 + 10 * k + 2].split(",")


def test_license_blocks(spark, noticed):
    """Each run of starts is found, with its first best block; the filters lose none."""
    scanner = licenses.Scanner(licenses.TEMPLATES, {}, {})
    texts = [t for _, t, *_ in noticed]
    for text, found in zip(texts, scanner.scan(pa.array(texts, pa.string())), strict=True):
        w = words_of(text)
        if len(w) > 2000:
            continue
        want = []
        for i, (_, template) in enumerate(licenses.TEMPLATES):
            t = words_of(template)
            own = set(t)
            common = [len(own & set(w[s : s + len(t)])) for s in range(max(1, len(w) - len(t) + 1))]
            meets = [s for s, c in enumerate(common) if c >= math.ceil(0.9 * len(own) - 1e-9)]
            for s in meets:
                if s - 1 not in meets:
                    e = s
                    while e + 1 in meets:
                        e += 1
                    best = max(range(s, e + 1), key=lambda x: (common[x], -x))
                    want.append((i, s, e, best, common[best] / len(own)))
        assert sorted((b["template"], b["first_start"], b["last_start"], b["start_word"], b["containment"]) for b in found["blocks"]) == want


def test_no_templates(spark, hard):
    got = licenses.licensed(hard, licenses.learn(hard, [], {}))
    assert got.where("labels <> '' or score <> 0 or n_base <> 0").isEmpty() and got.count() == hard.count()


def test_empty_tables(spark, hard):
    none = hard.where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    assert fim.digests(none).isEmpty() and fim.transform(none).isEmpty()
    assert resample.resampled(none, items).isEmpty()
    assert resample.resampled(hard, items).where("rank is not null").count() == resample.resampled(hard, items).where("n_words >= 20").count() * 10 // 100
    assert licenses.licensed(none, licenses.learn(none)).isEmpty()
