"""Properties that hold for any reads, each over one batch of generated reads."""

import random

from pyspark.sql import functions as F

from strandlake.functions import packed as P
from strandlake.functions import sequence as S
from strandlake.operators import counting, kmers


def _reads(spark, seed):
    r = random.Random(seed)
    rows = [(f"r{i}", "".join(r.choice("ACGTNacgtRYé-") for _ in range(r.choice([0, 1, 2, 5, 40, 300])))) for i in range(60)]
    return spark.createDataFrame(rows, "id string, sequence string")


def test_reverse_complement_twice(spark):
    df = _reads(spark, 1).withColumn("sequence", F.regexp_replace("sequence", "[^ACGTNacgtn]", ""))
    s = F.col("sequence")
    assert df.where(S.reverse_complement(S.reverse_complement(s)) != s).isEmpty()


def test_buckets_add_up(spark):
    r = counting.n_content(_reads(spark, 2)).first()
    assert r["count_n"] + r["count_acgt"] + r["count_ambiguous"] + r["count_other"] == r["total_bases"]


def test_canonical_is_symmetric(spark):
    df = kmers.kmer_rows(_reads(spark, 3), 5).where(S.is_clean(F.col("kmer")))
    k = F.col("kmer")
    assert df.where(S.canonical(k) != S.canonical(S.kmer_reverse_complement(k))).isEmpty()


def test_kmer_total(spark):
    df = _reads(spark, 4).withColumn("sequence", F.regexp_replace("sequence", "[^ACGT]", ""))
    want = sum(max(0, len(r["sequence"]) - 6) for r in df.collect())
    assert kmers.kmer_totals(kmers.kmer_counting(df, 7)).first()["total_kmers"] == want


def test_two_bit_round_trip(spark):
    df = _reads(spark, 5)
    s = F.col("sequence")
    assert df.where(P.decode(P.encode(s)) != S.two_bit_letters(s)).isEmpty()


def test_packed_arithmetic(spark):
    """Counts, complements and letters from packed bytes equal those of the letters, at every padding, with nulls."""
    rows = [("".join("ACGTacgtNx"[(i * 7 + j * j) % 10] for j in range(n)),) for i, n in enumerate([*range(18), 64, 4099])] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "s string").repartition(3).select("s", P.encode(F.col("s")).alias("p"))
    got = df.select("s", "p", P.decode(F.col("p")).alias("d"), P.letter_counts(F.col("p")).alias("n"), P.complement(F.col("p")).alias("c"), P.reverse_complement(F.col("p")).alias("r"), P.decode(P.reverse_complement(F.col("p"))).alias("rd")).collect()
    turn = str.maketrans("ACGT", "TGCA")
    for r in got:
        if r["s"] is None:
            assert not any(r[k] is not None for k in ("p", "d", "n", "c", "r", "rd"))
            continue
        letters = "".join(c if c in "ACGT" else "A" for c in r["s"].upper())

        def packed(x):
            codes = ["ACGT".index(c) for c in x] + [0] * (-len(x) % 4)
            return bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, len(codes), 4))

        assert (r["d"], r["p"]["length"], bytes(r["p"]["data"])) == (letters, len(letters), packed(letters))
        assert tuple(r["n"]) == tuple(letters.count(c) for c in "ACGT")
        assert bytes(r["c"]["data"]) == packed(letters.translate(turn)) and bytes(r["r"]["data"]) == packed(letters.translate(turn)[::-1])
        assert r["rd"] == letters.translate(turn)[::-1]


def test_sketch_similarity(spark):
    """Multisets of every overlap, with repeats, empty and missing ones, against counters."""
    import random
    from collections import Counter

    from strandlake.functions import hashing

    r = random.Random(2)
    rows = [([r.randrange(1 << 64) if r.random() < 0.2 else r.randrange(30) for _ in range(r.randrange(60))], [r.randrange(30) for _ in range(r.randrange(60))]) for _ in range(40)] + [([], []), ([1], []), (None, [1]), ([(1 << 64) - 1] * 3, [(1 << 64) - 1] * 2)]
    texts = [tuple(None if x is None else [str(v) for v in x] for x in row) for row in rows]
    df = spark.createDataFrame(texts, "a array<string>, b array<string>").selectExpr("cast(a as array<decimal(20,0)>) a", "cast(b as array<decimal(20,0)>) b").repartition(3)
    for row in df.select("a", "b", hashing.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = Counter(row["a"] or []), Counter(row["b"] or [])
        assert row["s"] == (sum((a & b).values()) / sum((a | b).values()) if a or b else 0.0)


def test_sketches_are_not_broadcast(spark, tmp_path):
    """Sketches of a small file are large: they meet by a merge, in eight bytes for each hash."""
    from strandlake.operators import kmers

    spark.createDataFrame([(f"r{i}", "ACGTTGCA" * 8) for i in range(50)], "id string, sequence string").write.parquet(str(tmp_path / "reads"))
    df = spark.read.parquet(str(tmp_path / "reads"))
    pairs = df.selectExpr("id a", "concat('r', (int(substr(id, 2)) + 1) % 50) b")
    found = kmers.jaccard_similarity(kmers.minhash_sketching(df, 5), pairs)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    assert [tuple(r) for r in found.select("similarity").distinct().collect()] == [(1.0,)] and found.count() == 50


def test_masking_stats_with_repeated_ids(spark):
    from strandlake.operators import transforms

    df = spark.createDataFrame([(f"id{i % 2}", "ACNn", "!I!!") for i in range(6)], "id string, sequence string, quality string")
    got = transforms.masking_stats(df, transforms.sequence_masking(df)).first()
    assert (got["total_bases"], got["masked_bases"]) == (24, 12)


def test_sql_functions(spark):
    """Nulls, empty reads and reads shorter than k, over several batches, and a k out of range."""
    import pytest

    from strandlake.functions import sql

    own = spark.newSession()
    sql.register(own)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [("a", "ACGTNACGT", "II"), ("b", "ac", None), ("c", None, None), ("d", "", ""), ("e", "ACG", "!"), ("f", "NNNN", "~~~~")] * 3
    own.createDataFrame(rows, "id string, sequence string, quality string").createOrReplaceTempView("reads")
    got = own.sql("SELECT id, place, kmer FROM kmers(TABLE(reads), 3)").collect()
    want = [(i, p, s[p : p + 3]) for i, s, _ in rows for p in range(len(s or "") - 2) if set(s[p : p + 3]) <= set("ACGT")]
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r[0] for r in own.sql("SELECT id FROM least_hashes(TABLE(reads), 3)").collect()} == {"a", "e"}
    found = {r["id"]: tuple(r)[1:] for r in own.sql("SELECT id, gc_percent(sequence), complexity(sequence), mean_quality(quality), decode_2bit(encode_2bit(sequence)) FROM reads").collect()}
    assert found == {"a": (50.0, 1.25, 73.0, "ACGTAACGT"), "b": (50.0, 1.0, None, "AC"), "c": (None, None, None, None), "d": (0.0, 0.0, 0.0, ""), "e": (200 / 3, 1.0, 33.0, "ACG"), "f": (0.0, 0.25, 126.0, "AAAA")}
    with pytest.raises(Exception, match="from 3 to 31"):
        own.sql("SELECT * FROM kmers(TABLE(reads), 2)").collect()


def test_position_counts(spark, monkeypatch):
    """Counts by position and code, by table and by sorting, with nulls, empty texts and characters beyond ASCII."""
    from collections import Counter

    from strandlake.functions import vectors

    for cells in (1 << 22, 0):
        monkeypatch.setattr(vectors, "_CELLS", cells)
        for rows in ([("II!",), (None,), ("",), ("~" * 500,), ("!I",)], [("Ié",), ("éI",), ("",)], [(None,)]):
            df = spark.createDataFrame(rows, "q string").repartition(2)
            got = Counter()
            for r in vectors.position_counts(df, "q").collect():
                got[r["pos"], r["q"]] += r["n"]
            assert got == Counter((i, ord(c)) for (t,) in rows if t for i, c in enumerate(t))
