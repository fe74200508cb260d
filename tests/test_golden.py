"""Hand-computed values of the read operators, and edge rows."""

import pytest
from pyspark.sql import functions as F

from strandlake.functions import packed as P
from strandlake.functions import sequence as S
from strandlake.functions.hashing import kmer_hashes
from strandlake.operators import counting, kmers, pairwise, quality, registry, transforms
from strandlake.operators import statistics as X
from strandlake.operators import tabular as T


@pytest.fixture
def reads(spark):
    def make(sequences, qualities=None):
        rows = [(i, f"seq{i}", s, (qualities or [None] * len(sequences))[i]) for i, s in enumerate(sequences)]
        return spark.createDataFrame(rows, "ord long, id string, sequence string, quality string")

    return make


def q(*codes):
    return "".join(map(chr, codes))


def one(df):
    return df.first().asDict()


def test_base_counting(reads):
    # GATTACA: A3 C1 G1 T2; CCGGN: C2 G2 N1; ttagn: A1 G1 T2 N1
    assert one(counting.base_counting(reads(["GATTACA", "CCGGN", "ttagn"]))) == {"count_a": 4, "count_c": 3, "count_g": 4, "count_t": 4, "count_n": 2, "total": 17}


def test_long_reads_do_not_wrap(reads):
    assert one(counting.base_counting(reads(["T" * 70_001])))["count_t"] == 70_001


def test_gc_content(reads):
    # G or C: 2 of GATTACA, 4 of CCGGN, 1 of ttagn; 15 letters are not N
    got = one(counting.gc_content(reads(["GATTACA", "CCGGN", "ttagn"])))
    assert (got["count_gc"], got["count_at"], got["count_n"], got["total_bases"], round(got["gc_percent"], 4)) == (7, 8, 2, 17, 46.6667)


def test_at_content(reads):
    got = one(counting.at_content(reads(["GATTACA", "CCGGN", "ttagn"])))
    assert (got["at_count"], got["total_bases"], round(got["at_percent"], 4)) == (8, 17, 47.0588)


def test_n_content(reads):
    # ambiguous: R, W, k, B; other: U, -, x
    got = one(counting.n_content(reads(["GATNRW", "nkB", "CU-x", "NN"])))
    assert (got["count_n"], got["count_acgt"], got["count_ambiguous"], got["count_other"]) == (4, 4, 4, 3)


def test_lengths(reads):
    assert one(counting.sequence_length(reads(["G" * 7, "T" * 11, "CATCAT", ""]))) == {"total_length": 24, "num_sequences": 4, "min_length": 0, "max_length": 11, "mean_length": 6.0}


def test_empty_inputs(reads):
    none = reads(["A"]).where("false")
    assert one(counting.base_counting(none))["total"] == 0
    assert one(counting.sequence_length(none)) == {"total_length": 0, "num_sequences": 0, "min_length": (1 << 63) - 1, "max_length": 0, "mean_length": 0.0}
    assert one(quality.quality_aggregation(none)) == {"min_quality": 255, "max_quality": 0, "total_quality": 0, "num_bases": 0, "mean_quality": 0.0}
    assert one(quality.quality_filter(none))["pass_rate"] == 0.0
    assert one(counting.complexity_score(none))["mean_complexity"] == 0.0
    with pytest.raises(ValueError):
        quality.require_quality(reads(["A"]))


def test_complexity(reads):
    # distinct letters over 4: 1/4 of CCCCC, 3/4 of CATCAT, 2/2 of GC, 5/4 of GATCN
    got = one(counting.complexity_score(reads(["CCCCC", "CATCAT", "GC", "GATCN"])))
    assert (got["low_complexity_count"], got["high_complexity_count"], got["mean_complexity"]) == (1, 3, 0.8125)
    assert one(reads([""]).select(S.complexity(F.col("sequence")).alias("x")))["x"] == 0.0


def test_quality_aggregation(reads):
    got = one(quality.quality_aggregation(reads(["CAT"] * 4, [q(90, 41, 62), q(70, 77, 50), None, ""])))
    assert (got["min_quality"], got["max_quality"], got["total_quality"], got["num_bases"], got["mean_quality"]) == (41, 90, 390, 6, 65.0)
    assert one(quality.quality_aggregation(reads(["CAT"], [q(31, 33, 50)]), 33))["total_quality"] == 17


def test_quality_statistics(reads):
    # position 0 has 36, 44, 60, 80: quartiles by interpolation at 42, 52, 65
    rows = {r["pos"]: r for r in quality.quality_statistics(reads(["CAT"] * 5, [q(80, 50), q(36, 52, 70), q(60), q(44), None])).collect()}
    assert (rows[0]["mean"], rows[0]["median"], rows[0]["q1"], rows[0]["q3"], rows[0]["count"]) == (55.0, 52.0, 42.0, 65.0, 4)
    assert [rows[p]["count"] for p in range(3)] == [4, 2, 1]
    low = quality.quality_statistics(reads(["CAT"] * 2, [q(60, 41, 72), q(58, 43, 70)]))
    assert [r["pos"] for r in quality.low_quality_positions(low, 45).collect()] == [1]


def test_filters(reads):
    df = reads(["GATC", "C" * 9, "T" * 15, "GA", "GA"], [q(70, 50, 70, 50), q(*[48] * 9), q(*[37] * 15), "", None])
    got = one(quality.quality_filter(df, 48))
    assert (got["total_sequences"], got["passed_sequences"], got["filtered_sequences"], got["pass_rate"]) == (5, 2, 2, 40.0)
    assert one(quality.length_filter(df, 9))["passed_sequences"] == 2
    assert sorted(r["sequence"] for r in quality.length_range(df, 4, 9).collect()) == ["CCCCCCCCC", "GATC"]
    assert [r["sequence"] for r in quality.quality_filter_rows(df).collect()] == ["GATC"]


def test_transforms(reads):
    got = [r["sequence"] for r in transforms.reverse_complement(reads(["GATTACA", "ccN", "TgW.", ""])).orderBy("id").collect()]
    assert got == ["TGTAATC", "Ngg", "NNcA", ""]
    assert one(transforms.sequence_masking(reads(["GATTA"], [q(80, 52, 53, 33, 70)])))["sequence"] == "GNTNA"
    assert one(transforms.sequence_masking(reads(["GAT"], [q(61, 62, 63)]), 62))["sequence"] == "NAT"
    assert one(transforms.sequence_masking(reads(["GAT"])))["sequence"] == "GAT"
    with pytest.raises(Exception, match="differ in length"):
        transforms.sequence_masking(reads(["GAT"], ["H"])).collect()
    df = reads(["GATTA", "NC"], [q(80, 40, 41, 42, 70), q(40, 80)])  # the N was one before
    assert one(transforms.masking_stats(df, transforms.sequence_masking(df))) == {"total_bases": 7, "masked_bases": 3, "masked_percentage": 300 / 7}


def test_adapter_trimming(reads):
    adapter = "CTGAGGCA"
    trim = lambda s, k, n: [(r["id"], r["sequence"]) for r in transforms.adapter_trimming(reads([s]), adapter, k, n).collect()]
    assert trim("TTATTA" + adapter + "GG", 8, 3) == [("seq0_trimmed", "TTATTA")]
    assert trim("TTATTACTGA", 4, 3) == [("seq0_trimmed", "TTATTA")]  # the beginning of the adapter is enough
    assert trim("TTATTACTGA", 6, 3) == [("seq0", "TTATTACTGA")]
    assert trim("TTATTA" + adapter, 4, 7) == []  # too short after the cut
    assert trim("TTATTA", 4, 7) == [("seq0", "TTATTA")]  # nothing cut, so length doesn't matter
    assert trim(adapter, 4, 0) == [("seq0_trimmed", "")]
    for overlap in (2, 9):
        with pytest.raises(ValueError):
            transforms.adapter_trimming(reads(["A"]), adapter, overlap)


def test_translation(reads):
    t = lambda s, f, n=1: [r["sequence"] for r in transforms.translation(reads([s]), f, n).collect()]
    # CAT GGC TGG AAA: His Gly Trp Lys; one on: ATG GCT GGA AA: Met Ala Gly; two on: TGG CTG GAA A: Trp Leu Glu
    assert [t("CATGGCTGGAAA", f) for f in range(3)] == [["HGWK"], ["MAG"], ["WLE"]]
    assert t("CATTGACAT", 0) == ["H"]  # TGA ends it
    assert t("CATCNTcat", 0) == ["HXX"] and t("TAACAT", 0) == [] and t("CA", 0) == []
    assert t("CATGGCTGGAAA", 0, 5) == []


def test_kmers(reads):
    rows = kmers.kmer_extraction(reads(["TTGTTG", "CA", "GCATNCAT"]), 3).collect()
    assert [r["sequence"] for r in rows if r["id"].startswith("seq0")] == ["TTG", "TGT", "GTT", "TTG"]
    assert [(r["id"], r["sequence"]) for r in rows if r["id"].startswith("seq2")] == [("seq2_kmer_0", "GCA"), ("seq2_kmer_1", "CAT"), ("seq2_kmer_5", "CAT")]
    once = kmers.kmer_extraction(reads(["TTGTTG"]), 3, True).collect()
    assert sorted((r["id"], r["sequence"]) for r in once) == [("seq0_kmer_0", "TTG"), ("seq0_kmer_1", "TGT"), ("seq0_kmer_2", "GTT")]
    got = kmers.kmer_extraction(reads(["GCAT"], [q(70, 50, 60, 40)]), 3).orderBy("id").collect()
    assert [(r["id"], r["quality"]) for r in got] == [("seq0_kmer_0", q(70, 50, 60)), ("seq0_kmer_1", q(50, 60, 40))]
    assert {r["kmer"]: r["count"] for r in kmers.kmer_counting(reads(["TTGTTG", "GTTnGTT"]), 3).collect()} == {"TTG": 2, "TGT": 1, "GTT": 3}
    # TTG and CAA are one k-mer read from either strand
    assert [tuple(r) for r in kmers.kmer_counting(reads(["TTG", "CAA"]), 3, True).collect()] == [("CAA", 2)]


def test_long_read(reads):
    """A million letters: windows, proteins and two-bit values without walking the read again for each."""
    import random

    s = "".join(random.Random(1).choices("ACGT", k=1_000_000))
    df = reads([s])
    totals = one(kmers.kmer_totals(kmers.kmer_counting(df, 11)))
    assert (totals["total_kmers"], totals["unique_kmers"]) == (len(s) - 10, len({s[i : i + 11] for i in range(len(s) - 10)}))
    assert kmers.kmer_extraction(df, 4, True).count() == 256
    assert one(df.select(P.decode(P.encode(F.col("sequence"))).alias("s")))["s"] == s
    no_stop = "CATGGC" * 150_000
    assert one(transforms.translation(reads([no_stop])))["sequence"] == "HG" * 150_000


def test_sketches(reads):
    import numpy as np

    # 64-bit FNV-1a of "GAT", by hand from offset and prime
    want = 14695981039346656037
    for c in b"GAT":
        want = (want ^ c) * 1099511628211 % 2**64
    hashes, at = kmer_hashes(np.frombuffer(b"NGATN", np.uint8), 3)
    assert (hashes.tolist(), at.tolist()) == ([want], [1])
    s = kmers.minhash_sketching(reads(["TTGTTGCA", "TTGTTGCA", "CCAGGTTA", "CA"]), 3, 4)
    rows = {r["sequence_id"]: r for r in s.collect()}
    assert rows["seq0"]["sketch"] == sorted(rows["seq0"]["sketch"]) and len(rows["seq0"]["sketch"]) == 4 and rows["seq3"]["sketch"] == []
    pairs = s.sparkSession.createDataFrame([("seq0", "seq1"), ("seq0", "seq2"), ("seq0", "seq3")], "a string, b string")
    got = {r["b"]: r["similarity"] for r in kmers.jaccard_similarity(s, pairs).collect()}
    assert got["seq1"] == 1.0 and got["seq2"] < 0.5 and got["seq3"] == 0.0


def test_distances(reads):
    words = ["GATTA", "GATCA", "CATCC", "TTTTT", "GATTA"]
    want = sorted((i, j, sum(x != y for x, y in zip(words[i], words[j], strict=True))) for j in range(5) for i in range(j))
    for tile in (2, 4096):
        assert sorted(map(tuple, pairwise.hamming_distance(reads(words), tile=tile).collect())) == want
        got = one(pairwise.hamming_summary(reads(words), tile=tile))
        assert got == {"num_pairs": 10, "min_distance": 0, "max_distance": max(d for *_, d in want), "mean_distance": sum(d for *_, d in want) / 10}
        near = pairwise.hamming_search(reads(words).where("ord < 2"), reads(words), 2, tile=tile).collect()
        assert sorted(map(tuple, near)) == sorted((a, b, d) for i, j, d in want for a, b in ((i, j), (j, i)) if a < 2 and d <= 2)
    with pytest.raises(Exception, match="differ in length"):
        pairwise.hamming_distance(reads(["G", "GA"])).collect()
    for a, b, d in (("GATTA", "GATA", 1), ("GATTA", "CATTAG", 2), ("", "GAT", 3), ("CCC", "GGG", 3)):
        assert pairwise.edit_distance(reads([a, b])).first()["distance"] == d
    assert pairwise.edit_distance(reads(["G", "A", "T", "C"]), 3).count() == 3
    assert one(pairwise.hamming_summary(reads(["G"]))) == {"num_pairs": 0, "min_distance": None, "max_distance": None, "mean_distance": 0.0}


def test_distances_of_other_reads(spark):
    """Long and empty reads, letters beyond ASCII and repeated keys, by brute force; reads are stored once, not for each block they meet."""
    import random

    r = random.Random(5)
    for size, letters in ((0, "A"), (3, "ACGTN"), (130, "ACGTNacgtn"), (300, "Aé漢😀")):
        rows = [(k // 2 if k < 6 else k, "".join(r.choice(letters) for _ in range(size))) for k in range(23)]
        df = spark.createDataFrame(rows, "ord long, sequence string").repartition(3)
        apart = lambda x, y: sum(a != b for a, b in zip(x, y, strict=True))
        want = sorted((i, j, apart(x, y)) for i, x in rows for j, y in rows if i % 3 == 0 and i != j)
        found = pairwise.hamming_search(df.where("ord % 3 = 0"), df, tile=4)
        assert sorted(map(tuple, found.collect())) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan
        once = sorted((i, j, d) for i, j, d in ((i, j, apart(x, y)) for i, x in rows for j, y in rows) if i < j)
        assert sorted(map(tuple, pairwise.hamming_distance(df, tile=4).collect())) == once
        for got, pairs in ((pairwise.hamming_summary(df, df.where("ord % 3 = 0"), tile=4), want), (pairwise.hamming_summary(df, tile=4), once)):
            d = [x for *_, x in pairs]
            assert tuple(got.first()) == (len(d), min(d), max(d), sum(d) / len(d))


def _blocks(r, size: int, letters: str, n: int, near: int) -> tuple[dict, object]:
    """Two blocks as they are stored, some keys in both, some texts near copies, and the distances of all their pairs."""
    import numpy as np

    texts = [["".join(r.choice(letters) for _ in range(size)) for _ in range(n)] for _ in "ab"]
    for k in range(near):
        texts[1][k] = "".join(r.choice(letters) if r.random() < k / near else x for x in texts[0][k])
    row = {}
    for side, own, first in zip("ab", texts, (0, n // 2), strict=True):
        found, counts, planes = pairwise._planes(own, size)
        values = {"size": size, "number": ord(side), "ords": np.arange(first, first + n).tobytes(), "letters": found, "counts": counts.tobytes(), "planes": planes.tobytes()}
        row |= {f"{k}_{side}": v for k, v in values.items()}
    a, b = (np.array([list(t) for t in own]) for own in texts)
    return row, (a[:, None] != b[None]).sum(2)


def test_distances_by_product(monkeypatch):
    """A product of signs finds the pairs within a distance without counting all pairs, and misses none."""
    import random

    import numpy as np

    def never(*_):
        raise AssertionError("all pairs counted")

    monkeypatch.setattr(pairwise, "_apart", never)
    r = random.Random(8)
    for size, letters, most in ((64, "ACGTACGTACGTACGN", 36), (64, "ACGT", 36), (41, "ACGTN", 0), (130, "ACGTNacgtn", 70), (300, "AC", 120), (7, "ACGT", 2), (64, "Aé漢😀", 33)):
        row, d = _blocks(r, size, letters, 301, 60)
        i, j = np.arange(301)[:, None], np.arange(150, 451)[None]
        want = sorted((int(x), int(y) + 150, int(d[x, y])) for x, y in np.argwhere((d <= most) & (i != j)))
        got = [k for columns in pairwise._listed(most, False)()(pairwise.Meeting(row, False, {})) for k in zip(*map(np.ndarray.tolist, columns), strict=True)]
        assert sorted(got) == want and len(want) > 0
    monkeypatch.undo()
    row, d = _blocks(r, 64, "ACGT", 200, 200)
    got = [c for columns in pairwise._listed(63, False)()(pairwise.Meeting(row, False, {})) for c in zip(*map(np.ndarray.tolist, columns), strict=True)]
    assert len(got) == sum(int(d[x, y]) <= 63 for x in range(200) for y in range(200) if x != y + 100)  # nearly all pairs: counted in full


def test_distance_bounds_by_product(monkeypatch):
    """Number and sum of distances come from counts of letters, the least and the greatest from products where a first bound is known."""
    import random

    import numpy as np

    r = random.Random(9)
    for size, letters, copies in ((64, "ACGTACGTACGTACGN", 0), (64, "ACGTN", 40), (130, "ACGTN", 10), (48, "ACGT", 0)):
        row, d = _blocks(r, size, letters, 301, copies)
        own = d[np.arange(301)[:, None] != np.arange(150, 451)[None]]
        low, high = int(own.min()) + 1, int(own.max()) - 1
        assert pairwise.Meeting(row, False, {}).totals() == (own.size, int(own.sum()))
        with monkeypatch.context() as patch:
            patch.setattr(pairwise, "_apart", None)
            got = list(pairwise._summed(low, high)()(pairwise.Meeting(row, False, {})))
        assert got == [([own.size], [int(own.sum())], [int(own.min())], [int(own.max())])]
        assert list(pairwise._summed(None, None)()(pairwise.Meeting(row, False, {}))) == got
        assert list(pairwise._summed(0, size)()(pairwise.Meeting(row, False, {}))) == [([own.size], [int(own.sum())], [0], [size])]
        same = row | {f"{k}_b": row[f"{k}_a"] for k in ("number", "ords", "letters", "counts", "planes")}
        (counted,) = pairwise._counted(pairwise.Meeting(same, True, {}))
        assert pairwise.Meeting(same, True, {}).totals() == (counted[0][0], counted[1][0])


def test_two_bit(reads):
    enc = reads(["TGCAG", "tnW", "", "G"]).select("id", P.encode(F.col("sequence")).alias("p"))
    got = {r["id"]: r for r in enc.select("id", "p.data", P.decode(F.col("p")).alias("s"), P.get(F.col("p"), F.lit(4)).alias("g"), P.decode(P.reverse_complement(F.col("p"))).alias("rc")).collect()}
    # T G C A = 11 10 01 00, G and padding = 10 00 00 00
    assert bytes(got["seq0"]["data"]) == b"\xe4\x80" and got["seq0"]["g"] == "G" and got["seq0"]["rc"] == "CTGCA"
    assert got["seq1"]["s"] == "TAA" and got["seq1"]["rc"] == "TTA" and got["seq1"]["g"] is None
    assert bytes(got["seq2"]["data"]) == b"" and got["seq2"]["s"] == "" and bytes(got["seq3"]["data"]) == b"\x80"


def test_registry(spark, reads):
    assert len(registry.names()) == 20 and "fastq_parsing" in registry.names("io")
    assert one(registry.get("base_counting").apply(reads(["GATTACA"])))["total"] == 7
    assert sum(r["n"] for r in registry.by_category(spark).collect()) == 20
    with pytest.raises(KeyError):
        registry.get("unknown")
    with pytest.raises(ValueError):
        registry.register(registry.get("gc_content"))


def test_statistics(spark):
    rows = [("a", float(x)) for x in (10, 11, 12, 11, 10, 12, 11, 100)] + [("b", 1.0), ("b", 2.0)]
    got = {r["k"]: r for r in X.summary(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert (got["a"]["n_valid"], got["a"]["n_outliers"], got["a"]["median"], got["a"]["max"]) == (7, 1, 11.0, 12.0)
    assert got["b"]["mean"] is None and got["b"]["n_valid"] == 2
    assert spark.range(1).select(X.effect_label(F.lit(0.5))).first()[0] == "medium"
    assert spark.range(1).select(X.amdahl_bound(F.lit(0.0))).first()[0] == 20.0


def test_interval_join_is_closed(spark):
    samples = spark.createDataFrame([(10.0, 1.0), (70.0, 3.0), (71.0, 9.0)], "t double, v double")
    windows = spark.createDataFrame([(1, 10.0, 60.0), (2, 500.0, 5.0)], "k int, s double, d double")
    got = {r["k"]: (r["mean_value"], r["num_samples"]) for r in T.interval_join(samples, windows, "t", "s", "d", "k", "v").collect()}
    assert got == {1: (2.0, 2), 2: (0.0, 0)}


def test_lookup_without_a_match_is_an_error(spark):
    facts, dim = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, name string")
    with pytest.raises(Exception, match="no k 2"):
        T.lookup(facts, dim, "k", "name").collect()


def test_models(spark):
    from strandlake.operators.models import KINDS, cross_validated

    df = spark.range(60).select((F.col("id") / 10).alias("x"), (F.col("id") * 0.3 + 1).alias("y"))
    assert cross_validated(df, "linear", ["x"], "y", folds=2)["r2"] > 0.99 and len(KINDS) == 4


def test_p_values(spark):
    """Two-sided p of t against values with a closed form: 1 and 2 degrees of freedom, and the normal limit."""
    import math

    from strandlake.operators.statistics import incomplete_beta, t_p_value

    cases = [(t, v) for t in (0.0, 0.3, 1.0, 2.5, 40.0) for v in (1, 2)] + [(1.0, 10**7), (1.96, 10**7), (3.0, 10**7)]
    df = spark.createDataFrame([(float(t), v) for t, v in cases], "t double, v long")
    exact = lambda t, v: 1 - 2 / math.pi * math.atan(t) if v == 1 else 1 - t / math.sqrt(2 + t * t) if v == 2 else math.erfc(t / math.sqrt(2))
    for r in df.select("t", "v", t_p_value(F.col("t"), F.col("v")).alias("p"), t_p_value(-F.col("t"), F.col("v")).alias("q")).collect():
        assert abs(r["p"] - exact(r["t"], r["v"])) < 1e-7 and r["p"] == r["q"]
    odd = spark.createDataFrame([(None, 3), (1.0, None), (1.0, 0)], "t double, v long")
    assert [r[0] for r in odd.select(t_p_value(F.col("t"), F.col("v"))).collect()] == [None] * 3
    # I_x(a, b) = 1 - I_{1-x}(b, a), and powers where one parameter is 1.
    grid = spark.createDataFrame([(a, b, x) for a in (0.5, 1.0, 3.0, 80.0) for b in (0.5, 1.0, 20.0) for x in (0.0, 0.01, 0.4, 0.9, 1.0)], "a double, b double, x double")
    for r in grid.select("*", incomplete_beta(F.col("a"), F.col("b"), F.col("x")).alias("i"), incomplete_beta(F.col("b"), F.col("a"), 1 - F.col("x")).alias("j")).collect():
        assert abs(r["i"] + r["j"] - 1) < 1e-12
        if r["b"] == 1:
            assert abs(r["i"] - r["x"] ** r["a"]) < 1e-12


@pytest.fixture
def many_ranges(spark):
    """Small results are not put together, so that they lie in several ranges."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_ranks_in_one_hot_group(spark, many_ranges):
    """All rows in one group, most with one value, and a null group: indexes and intervals equal those of sorted lists."""
    from strandlake.operators import ranking, tabular
    from strandlake.operators.statistics import nearest_ranks, summary

    rows = [("a", float((i * 7919) % 4001) if i % 3 else 5.0) for i in range(12_000)] + [(None, float(i)) for i in range(10)] + [("b", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: (r["p10"], r["p50"], r["p99"]) for r in nearest_ranks(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for g in ("a", None, "b"):
        v = sorted(x for k, x in rows if k == g)
        assert got[g] == tuple(v[len(v) * share // 100] for share in (10, 50, 99))
    assert {r["g"]: r["n_valid"] for r in summary(df, ["g"], "v").collect()}[None] == 10
    ranges = ranking.ranged(df, ["g", "v"])
    assert ranges.where("g = 'a'").select("_range").distinct().count() > 1
    placed = sorted((r["place"], r["v"]) for r in ranking.numbered(df.where("g = 'a'"), ["v"]).collect())
    assert [p for p, _ in placed] == list(range(12_000)) and [v for _, v in placed] == sorted(v for k, v in rows if k == "a")
    # A crowded moment, windows that touch it, end on it, are empty, and turned round.
    samples = spark.createDataFrame([(100.0 if i % 3 else float(i), i, float(i) / 8) for i in range(9000)] + [(None, 1, 1.0), (7.0, None, None)], "t double, n long, x double")
    windows = spark.createDataFrame([(1, 100.0, 0.0), (2, 99.5, 0.5), (3, 100.5, 3.0), (4, 0.0, 1e6), (5, 100.0, -1.0), (6, None, 1.0), (7, 7.0, 0.0)], "k long, s double, d double")
    for value in ("n", "x"):
        got = {r["k"]: (r["mean_value"], r["num_samples"]) for r in tabular.interval_join(samples, windows, "t", "s", "d", "k", value).collect()}
        have = [(r["t"], r[value]) for r in samples.collect() if r["t"] is not None]
        for k, s, d in ((r["k"], r["s"], r["d"]) for r in windows.collect()):
            met = [v for t, v in have if s is not None and s <= t <= s + d]
            full = [v for v in met if v is not None]
            assert got[k][1] == len(met) and abs(got[k][0] - (sum(full) / len(full) if full else 0.0)) < 1e-9


def _points(spark):
    """A curve of two features, a step, and noise; a row without a feature."""
    import random

    r = random.Random(4)
    rows = [(i, r.uniform(-3, 9), r.uniform(100, 140)) for i in range(600)]
    out = [(i, x, z, 2 + 3 * x - 0.5 * x * x + 0.1 * x * z + r.gauss(0, 0.5), (10.0 if x > 2 else -10.0) + (5.0 if z > 120 else 0.0) + r.gauss(0, 0.1)) for i, x, z in rows]
    return spark.createDataFrame([*out, (600, None, 1.0, 1.0, 1.0)], "i long, x double, z double, curve double, step double")


def test_least_squares(spark):
    """Weights and R squared of all rows and of each fold, against numpy on the rows themselves."""
    import numpy as np

    from strandlake.operators import models

    df = _points(spark)
    rows = np.array([tuple(r) for r in df.dropna().select("i", "x", "z", "curve").collect()])
    for degree in (1, 2):
        fit = models.least_squares(df, ["x", "z"], "curve", F.col("i") % 4, degree)
        columns = {(): np.ones(len(rows)), ("x",): rows[:, 1], ("z",): rows[:, 2], ("x", "x"): rows[:, 1] ** 2, ("x", "z"): rows[:, 1] * rows[:, 2], ("z", "z"): rows[:, 2] ** 2}
        a, y = np.stack([columns[t] for t in fit.terms], 1), rows[:, 3]
        w = np.linalg.lstsq(a, y, rcond=None)[0]
        assert np.allclose(fit.weights, w, rtol=1e-6, atol=1e-6)
        assert abs(fit.r2 - (1 - ((y - a @ w) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
        for k in range(4):
            own = rows[:, 0] % 4 == k
            v = np.linalg.lstsq(a[~own], y[~own], rcond=None)[0]
            want = 1 - ((y[own] - a[own] @ v) ** 2).sum() / ((y[own] - y[own].mean()) ** 2).sum()
            assert abs(fit.fold_r2[k] - want) < 1e-8
        got = [r[0] for r in df.dropna().orderBy("i").select(fit.predict()).collect()]
        assert np.allclose(got, (a @ w)[np.argsort(rows[:, 0])], atol=1e-6)
    assert np.allclose(fit.weights[:3], [2, 3, 0], atol=60) and fit.cv_r2 > 0.99
    assert models.least_squares(df.where("false"), ["x"], "curve", F.lit(0)).fold_r2 == []


def test_tree_models(spark):
    """Trees follow a step that a line can't; every kind is compared, and least squares agrees with Spark ML."""
    from strandlake.operators import models

    df = _points(spark).dropna()
    got = {r["kind"]: r for r in models.compared(df, ["x", "z"], "step", 3).collect()}
    assert list(got) == list(models.KINDS)
    assert all(got[k]["cv_r2"] > got["linear"]["cv_r2"] and got[k]["mae"] < got["linear"]["mae"] for k in ("random_forest", "gradient_boosting")), got
    assert got["gradient_boosting"]["r2"] > 0.98 and got["linear"]["r2"] < 0.9
    for kind, degree in (("linear", 1), ("quadratic", 2)):
        assert abs(models.least_squares(df, ["x", "z"], "step", F.col("i") % 3, degree).r2 - got[kind]["r2"]) < 1e-4


def test_boosting_over_cells(spark):
    """One row for each cell of equal features, weighted, grows the trees of all rows."""
    import numpy as np

    from strandlake.operators import models

    rows = [(float(i % 7), float(i % 3), float(i % 7 > 3) * 10 + float(np.sin(i * i))) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, z double, y double").repartition(2)
    ours, plain = (m.transform(df).groupBy("x", "z").agg(F.avg("prediction").alias("p")) for m in (models.trained(df, "gradient_boosting", ["x", "z"], "y"), models.regression("gradient_boosting", ["x", "z"], "y").fit(df)))
    assert all(abs(r["p"] - r["q"]) < 1e-6 for r in ours.join(plain.withColumnRenamed("p", "q"), ["x", "z"]).collect())
    kept = models._dealt(df, ["x", "z"], "y", 5, 42)
    assert kept.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism and kept.where("_fold between 0 and 4").count() == 400
    kept.unpersist()


def test_fits_over_cells(spark, monkeypatch):
    """Every fit of a comparison sees a row for each cell, and its scores are those of the rows; a forest's bootstraps are of rows."""
    from pyspark.ml.evaluation import RegressionEvaluator

    from strandlake.operators import models

    sizes = []

    class Forest(models.RandomForestRegressor):
        def fit(self, dataset, params=None):
            sizes.append(dataset.count())
            return super().fit(dataset, params)

    rows = [(float(i % 7), float(i % 3), 1000.0 + float(i % 7 > 3) * 10 + i * i % 11) for i in range(2000)]
    df = spark.createDataFrame(rows, "x double, z double, y double").repartition(2)
    monkeypatch.setattr(models, "RandomForestRegressor", Forest)
    got = {r["kind"]: r for r in models.compared(df, ["x", "z"], "y", 2).collect()}
    assert len(sizes) == 3 * 20 and max(sizes) <= 21, sizes
    monkeypatch.undo()
    for kind, off in (("linear", 1e-9), ("quadratic", 1e-9), ("gradient_boosting", 1e-6), ("random_forest", 0.05)):
        predictions = models.regression(kind, ["x", "z"], "y").fit(df).transform(df)
        r2, mae = (RegressionEvaluator(labelCol="y", metricName=m).evaluate(predictions) for m in ("r2", "mae"))
        assert abs(got[kind]["r2"] - r2) < off and abs(got[kind]["mae"] - mae) < 10 * off and abs(got[kind]["cv_r2"] - r2) < 0.1, (kind, r2, mae, got[kind])
    cells = models._cells(models._folded(df, 2, 1), ["x", "z"], "y", 1000.0, 8, 1).collect()
    assert sum(r["_n"] for r in cells) == 2000 and abs(sum(r["_s"] for r in cells) - sum(y - 1000 for *_, y in rows)) < 1e-6
    off = [(r[f"_w{t}"] - r["_n"]) / r["_n"] ** 0.5 for r in cells for t in range(8)]
    assert abs(sum(off) / len(off)) < 0.3 and 0.7 < sum(x * x for x in off) / len(off) < 1.3  # a Poisson's variance is its mean
    with pytest.raises(Exception, match="is null"):
        models.compared(df.union(spark.createDataFrame([(1.0, None, 2.0)], df.schema)), ["x", "z"], "y", 2)
