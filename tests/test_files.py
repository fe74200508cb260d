"""Files: parsing modes, splits, compression, generators, validation, logs."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandlake.sources import bgzf, compressed, fastq, generate, tables, validation
from strandlake.streaming import pipelines

GOOD = "@SEQ1\nACGT\n+\nIIII\n@SEQ2\nGGTT\n+\nJJJJ\n"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parse_modes():
    bad = ["SEQ0", "@SEQ1", "ACGT", "+", "IIII", "@SEQ2", "GG", "+", "J", "@SEQ3", "A"]
    assert [r[0] for r in fastq.parse(bad[1:], "DROPMALFORMED")] == ["SEQ1"]
    assert [r[0] for r in fastq.parse(bad, "RESYNC")] == ["SEQ1", "SEQ2"]
    assert [r[0] for r in fastq.parse(["x", "A", "?", "I", "", "more"], "PERMISSIVE")] == ["x"]
    for lines in (["SEQ"] + bad[2:5], ["@a", "A", "-", "I"], ["@a", "AC", "+", "I"], ["@a", "A"]):
        with pytest.raises(ValueError):
            list(fastq.parse(lines))
    assert list(fastq.parse(["@a", "A", "+", "\x01"])) and fastq.problem(["@a", "A", "+", "\x01"], True)


def test_read_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text(GOOD)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(GOOD)
    want = [("SEQ1", "ACGT", "IIII"), ("SEQ2", "GGTT", "JJJJ")]
    assert rows(fastq.read_fastq(spark, str(tmp_path / "a.fq"))) == want
    assert rows(fastq.read_fastq(spark, str(tmp_path / "b.fq.gz"))) == want
    assert rows(fastq.read_fastq(spark, str(tmp_path / "a.fq"), mode="RESYNC")) == want
    import zstandard

    (tmp_path / "c.fq.zst").write_bytes(zstandard.ZstdCompressor().compress(GOOD.encode()))
    assert rows(fastq.read_fastq(spark, str(tmp_path / "c.fq.zst"))) == want


def test_splits_find_their_records(spark, tmp_path):
    """Headers and qualities full of @ and +, cut into many small splits."""
    made = generate.generate_reads(spark, 300, mean=60, quality="uniform_range", seed=3).select("id", "sequence", F.translate("quality", "!\"#$%", "@+@+@").alias("quality"))
    want = rows(made)
    text = "".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in want)
    (tmp_path / "a.fq").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert rows(fastq.read_fastq(spark, str(tmp_path / "a.fq"))) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "a.fq.bgz").write_bytes(bgzf.deflate(text.encode(), 1500))
    for size in (100, 700, 5000, 1 << 20):
        assert rows(bgzf.read_bgzf(spark, str(tmp_path / "a.fq.bgz"), part_bytes=size)) == want


def _read_bgzf(text, path, size, mode="FAILFAST", block=65280):
    """What all parts of a file yield, one after the other, by an index made here."""
    path.write_bytes(bgzf.deflate(text.encode(), block))
    parts, before = {}, 0
    with open(path, "rb") as f:
        for at, _, data in bgzf.blocks(f, 0, path.stat().st_size):
            part = parts.setdefault(at // size, [at, before, 0])
            part[2] += data.count(b"\n")
            before += data.count(b"\n")
    found = [bgzf.reads_batch(columns, n, "f", mode, False) for at, b, lines in parts.values() for columns, n in bgzf.part_records(str(path), at, b, lines, mode)]
    return [tuple(r.values()) for batch in found for r in batch.to_pylist()]


def test_bgzf_long_records(tmp_path):
    """Records longer than many ranges, and short ones among them."""
    r = random.Random(1)
    want = []
    for i in range(12):
        n = r.choice([3, 50, 200_000, 400_000])
        want.append((f"r{i}", "".join(r.choices("ACGT", k=n)), "".join(r.choices("@+I5", k=n))))
    text = "".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in want)
    for size in (1, 5000, 60_000, 1 << 22):
        assert _read_bgzf(text, tmp_path / "x.bgz", size) == want
    assert _read_bgzf(text.rstrip("\n"), tmp_path / "x.bgz", 60_000) == want


#: Lines that no record should hold, after some record, or in its place.
STRAY = {"one line": ["stray"], "two lines": ["@x", "y"], "five lines": ["@a", "b", "+", "d", "@e"], "an empty line": [""]}


def _faulty(n, stray=None, after=5, bad_every=0):
    """Lines of n records, with a stray part after one of them, or every so many bad."""
    r = random.Random(n)
    lines = []
    for i in range(n):
        size = r.randrange(1, 60)
        quality = "".join(r.choices("@+I5", k=size + (1 if bad_every and i % bad_every == 3 else 0)))
        lines += [f"@r{i}", "".join(r.choices("ACGT", k=size)), "+", quality]
        if stray is not None and i + 1 == after:
            lines += stray
    return lines


@pytest.mark.parametrize("mode", ["DROPMALFORMED", "PERMISSIVE", "RESYNC"])
def test_splits_do_not_change_results(spark, tmp_path, mode):
    """Every mode gives what it gives line by line, whatever the splits, with stray lines and bad records."""
    cases = [_faulty(120, x, a) for x in STRAY.values() for a in (5, 61)] + [_faulty(120, bad_every=10), _faulty(41)[:-2], [x + "\r" for x in _faulty(30)], ["@a"]]
    want = sorted(r for lines in cases for r in fastq.parse((x.rstrip("\r") for x in lines), mode))
    for k, lines in enumerate(cases):
        (tmp_path / f"{k}.fq").write_bytes("\n".join(lines).encode() + b"\n" * (k % 2))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "3000", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert rows(fastq.read_fastq(spark, str(tmp_path), mode=mode)) == want, size
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30")  # splits without a line's end
        assert rows(fastq.read_fastq(spark, str(tmp_path / "9.fq"), mode=mode)) == sorted(fastq.parse(cases[9], mode))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_failfast_across_splits(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for k, lines in enumerate((_faulty(200, ["stray"], 100), _faulty(200)[:-1], _faulty(200, bad_every=150))):
            (tmp_path / f"{k}.fq").write_text("\n".join(lines) + "\n")
            for size in ("128m", "1900"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                with pytest.raises(Exception, match="header|incomplete|differ"):
                    fastq.read_fastq(spark, str(tmp_path / f"{k}.fq")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_scan_of_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write(GOOD)
    for path in (tmp_path / "a.fq.gz", tmp_path):
        plan = fastq.read_fastq(spark, str(path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan text") == 1 and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("kind", ["gzip", "zstd", "bgzf", "none"])
def test_compressed_source(spark, tmp_path, kind):
    """Written by tasks, read as streams whose pieces cut lines and records anywhere."""
    made = generate.generate_reads(spark, 500, mean=60, quality="uniform_range", seed=8, partitions=3).select("id", "sequence", F.when(F.col("id").endswith("7"), None).otherwise(F.col("quality")).alias("quality"))
    want = sorted((a, b, c if c is not None else "?" * len(b)) for a, b, c in rows(made.fillna("none", ["id"])))
    compressed.write_compressed(made, str(tmp_path / "out"), kind)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) == 3 and all(x.endswith(compressed.EXTENSIONS[kind]) for x in names)
    for size in (7, 1000, 1 << 20):
        reader = spark.read.format("compressed_fastq").option("pieceBytes", size).option("compression", kind)
        assert rows(reader.load(str(tmp_path / "out"))) == want
    if kind == "bgzf":
        stored = bgzf.index(spark, str(tmp_path / "out"), 3000)
        stored.write.parquet(str(tmp_path / "index"))
        assert rows(bgzf.read_bgzf(spark, "", stored=spark.read.parquet(str(tmp_path / "index")), part_bytes=2000)) == want


def test_compressed_source_modes(spark, tmp_path):
    compressed.register(spark)
    for name, lines in (("stray", _faulty(300, ["stray", "x"], 50)), ("bad", _faulty(300, bad_every=10)), ("cut", _faulty(20)[:-2]), ("empty", [])):
        data = "".join(x + "\n" for x in lines).encode()
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]))
        for mode in ("DROPMALFORMED", "PERMISSIVE", "RESYNC"):
            got = spark.read.format("compressed_fastq").option("mode", mode).option("pieceBytes", 50).load(str(tmp_path / f"{name}.gz"))
            assert rows(got) == sorted(fastq.parse(lines, mode)) == rows(fastq.read_fastq(spark, str(tmp_path / f"{name}.gz"), mode=mode) if lines else got)
        if name != "empty":
            with pytest.raises(Exception, match="header|incomplete|differ"):
                spark.read.format("compressed_fastq").load(str(tmp_path / f"{name}.gz")).collect()
    assert b"".join(compressed._gunzipped(iter([gzip.compress(b"a\n") + b"\0" * 9, b"\0", gzip.compress(b"b")]))) == b"a\nb"
    (tmp_path / "half.gz").write_bytes(gzip.compress(GOOD.encode() * 500)[:-40])
    with pytest.raises(Exception, match="end mark|Error"):
        spark.read.format("compressed_fastq").load(str(tmp_path / "half.gz")).collect()


def test_long_stream_in_bounded_memory():
    """A text far longer than a piece, of records longer than one: no more than a few pieces are held."""
    n = 400
    record = b"@r\n" + b"ACGT" * 30_000 + b"\n+\n" + b"IIII" * 30_000 + b"\n"
    import zlib

    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = b"".join([c.compress(record * 10) for _ in range(n // 10)] + [c.flush()])
    framer, seen, most = compressed.Framer("FAILFAST"), 0, 0
    pieces = compressed._gunzipped(data[i : i + 1000] for i in range(0, len(data), 1000))
    for lines in compressed.line_batches(pieces):
        columns, _ = framer.add(lines)
        seen += len(columns[0])
        most = max(most, lines.nbytes)
    assert seen == n and most < 3 * compressed.PIECE_BYTES and not framer.rest()


def test_bgzf_malformed(spark, tmp_path):
    """Parts of any size leave out what the whole file leaves out, where a part begins with a bad record too."""
    for name, lines in (("bad", _faulty(400, bad_every=10)), ("stray", _faulty(400, ["stray"], 5)), ("late", _faulty(400, ["@x", "y"], 200)), ("cut", _faulty(40)[:-1])):
        text = "".join(x + "\n" for x in lines)
        want = list(fastq.parse(lines, "DROPMALFORMED"))
        for size, block in ((1 << 20, 700), (2000, 700), (700, 700), (1, 300)):
            assert _read_bgzf(text, tmp_path / "x.bgz", size, "DROPMALFORMED", block) == want, (name, size)
        with pytest.raises(ValueError):
            _read_bgzf(text, tmp_path / "x.bgz", 2000, block=700)
    (tmp_path / "y.bgz").write_bytes(bgzf.deflate(text.encode(), 700))
    assert rows(bgzf.read_bgzf(spark, str(tmp_path / "y.bgz"), "DROPMALFORMED", part_bytes=500)) == sorted(want)


def test_bgzf_index(spark, tmp_path):
    """Places, sizes and line counts of the blocks, and records fetched by number from few blocks."""
    for k in range(2):
        (tmp_path / f"{k}.bgz").write_bytes(bgzf.deflate("".join(x + "\n" for x in _faulty(300 + k)).encode(), 900))
    found = bgzf.index(spark, str(tmp_path / "*.bgz"), 1500)
    for k in range(2):
        want, before = [], 0
        with open(tmp_path / f"{k}.bgz", "rb") as f:
            for at, size, data in bgzf.blocks(f, 0, (tmp_path / f"{k}.bgz").stat().st_size):
                want.append((at, at << 16, size, len(data), data.count(b"\n"), before))
                before += data.count(b"\n")
        assert rows(found.where(F.col("file").endswith(f"{k}.bgz")).drop("file")) == sorted(want)
    found.write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    for first, last in ((0, 0), (17, 17), (60, 90), (299, 305)):
        got = bgzf.fetch(stored, first, last)
        want = [(i, f"r{i}") for k in range(2) for i in range(first, min(last, 299 + k) + 1)]
        assert sorted((r["record"], r["id"]) for r in got.collect()) == sorted(want)


def test_bgzf_truncated(tmp_path):
    text = "".join(f"@r{i}\n{'ACGT' * 50}\n+\n{'I' * 200}\n" for i in range(40))
    for cut in (len(text) - 100, len(text) - 205, len(text) - 400):
        for size in (50, 300, 1 << 20):
            with pytest.raises(ValueError):
                _read_bgzf(text[:cut], tmp_path / "t.bgz", size, block=700)
        assert len(_read_bgzf(text[:cut], tmp_path / "t.bgz", 1 << 20, "DROPMALFORMED", 700)) == 39


def test_named_compression(spark, tmp_path):
    """A compression that the file's name doesn't tell, and a name that tells a wrong one."""
    with gzip.open(tmp_path / "a.data", "wt") as f:
        f.write(GOOD)
    (tmp_path / "b.gz").write_text(GOOD)
    want = [("SEQ1", "ACGT", "IIII"), ("SEQ2", "GGTT", "JJJJ")]
    assert rows(fastq.read_fastq(spark, str(tmp_path / "a.data"), compression="gzip")) == want
    assert rows(fastq.read_fastq(spark, str(tmp_path / "b.gz"), compression="none")) == want


def test_malformed_records(spark, tmp_path):
    (tmp_path / "a.fq").write_text(GOOD + "@bad\nACGT\n+\nII\n" + GOOD)
    assert len(rows(fastq.read_fastq(spark, str(tmp_path / "a.fq"), mode="DROPMALFORMED"))) == 4
    with pytest.raises(Exception, match="differ in length"):
        fastq.read_fastq(spark, str(tmp_path / "a.fq")).collect()


def test_file_validation(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@a\nACGT\n+\nIIII\nb\nACXT\n-\nII\n@\nAC\n+\nI\x01\n@d\nAC\n")
    found = validation.file_records(spark, str(tmp_path / "a.fq"))
    issues = [("alphabet", 2), ("empty_id", 3), ("header", 2), ("length_mismatch", 2), ("plus", 2), ("quality_range", 3), ("truncated", 4)]
    assert sorted((r["issue"], r["record"]) for r in validation.file_issues(found).collect()) == sorted([*issues, ("empty_id", 2)])
    got = validation.file_report(found).first()
    assert (got["num_records"], got["min_length"], got["max_length"], got["num_issues"]) == (4, 2, 4, 8)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write("ACGT\n>\nAC\nGT\n>x\n>y\nAZ\n")
    found = validation.file_records(spark, str(tmp_path / "b.fa.gz"), "fasta")
    assert sorted((r["record"], r["issue"]) for r in validation.file_issues(found).collect()) == [(1, "header"), (2, "empty_id"), (3, "no_sequence"), (4, "alphabet")]
    (tmp_path / "none.fq").write_text("")
    with pytest.raises(ValueError):
        validation.require_records(validation.file_records(spark, str(tmp_path / "none.fq")))


def test_file_validation_across_splits(spark, tmp_path):
    """Record numbers and issues of whole files, at every split size."""
    lines = _faulty(120, ["@x", "stray"], 70, bad_every=9)
    (tmp_path / "a.fq").write_text("\n".join(lines) + "\n")
    fasta = "ACGT\n" + "".join(f">h{i}\n" + ("ACGT\n" * (i % 40)) + ("AXG\n" if i % 7 == 0 else "") for i in range(60)) + ">\nAC\n>last"
    (tmp_path / "b.fa").write_text(fasta)
    import zstandard

    (tmp_path / "c.fa.zst").write_bytes(zstandard.ZstdCompressor().compress(fasta.encode()))
    (tmp_path / "d.fq.zst").write_bytes(zstandard.ZstdCompressor().compress((tmp_path / "a.fq").read_bytes()))
    want, old = {}, spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "900", "60"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for kind, name in (("fastq", "a.fq"), ("fasta", "b.fa")):
                got = rows(validation.file_records(spark, str(tmp_path / name), kind).drop("file"))
                assert want.setdefault(kind, got) == got, (kind, size)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows(validation.file_records(spark, str(tmp_path / "c.fa.zst"), "fasta").drop("file")) == want["fasta"]
    assert rows(validation.file_records(spark, str(tmp_path / "d.fq.zst")).drop("file")) == want["fastq"]
    assert [r[0] for r in want["fasta"]] == list(range(1, 64)) and want["fasta"][0][1:] == (4, ["header"]) and want["fasta"][-1][2] == ["no_sequence"]
    groups = [lines[i : i + 4] for i in range(0, len(lines), 4)]
    assert [r[0] for r in want["fastq"]] == list(range(1, len(groups) + 1)) and want["fastq"][-1][2] == ["truncated"]
    assert [r[1] for r in want["fastq"]] == [len(g[1]) for g in groups]
    assert [("length_mismatch" in r[2]) for r in want["fastq"][:-1]] == [len(g[1]) != len(g[3]) for g in groups[:-1]]


def test_report_file(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT", "IIII"), ("", "AX", "I")], "id string, sequence string, quality string")
    for k, made in enumerate((validation.report(df), validation.report(df.where("false")))):
        validation.write_report(made, str(tmp_path / str(k)))
        assert rows(validation.read_report(spark, str(tmp_path / str(k)))) == rows(made)
    text = spark.read.text(str(tmp_path / "1")).first()["value"]
    assert text == '{"file_format":"fastq","num_records":0,"min_length":null,"max_length":null,"mean_length":null,"num_issues":0}'


def test_result_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1 / 3, 2.0), ("b", None, 1e-7)], "k string, x double, y double")
    tables.write_results(df, str(tmp_path / "csv"), "csv", {"x": 2, "y": 6})
    text = sorted(r["value"] for r in spark.read.text(str(tmp_path / "csv")).collect())
    assert set(text) == {"k,x,y", "a,0.33,2.000000", "b,,0.000000"}
    for kind in ("parquet", "json"):
        tables.write_results(df, str(tmp_path / kind), kind)
        assert rows(spark.read.format(kind).load(str(tmp_path / kind)).select("k", "x", "y")) == rows(df)
    (tmp_path / "noisy.csv").write_text("k,x\n[noise]\na,1.5\n")
    assert rows(tables.read_csv(spark, str(tmp_path / "noisy.csv"), "k string, x double", "[")) == [("a", 1.5)]


def test_batches_equal_whole(spark, tmp_path):
    """Results that add up don't depend on how the stream is cut; those of single records need no state."""
    generate.generate_fixed(spark, 300, 40, seed=5, partitions=6).write.parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    for files in (1, 3):
        out = str(tmp_path / f"out{files}")
        pipelines.complete_to(pipelines.running_counts(pipelines.stream_parquet(spark, str(tmp_path / "in"), files)), out, str(tmp_path / f"c{files}")).awaitTermination()
        assert rows(spark.read.parquet(out)) == rows(pipelines.running_counts(whole))
    assert {r["n"] for r in whole.selectExpr("length(sequence) as n").collect()} == {40}


def test_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT" * 40, None), ("b", "GG", "II")], "id string, sequence string, quality string")
    fastq.write_fastq(df, str(tmp_path / "fq"))
    assert rows(fastq.read_fastq(spark, str(tmp_path / "fq"))) == [("a", "ACGT" * 40, "?" * 160), ("b", "GG", "II")]
    fastq.write_fasta(df, str(tmp_path / "fa"))
    assert rows(fastq.read_fasta(spark, str(tmp_path / "fa"))) == [("a", "ACGT" * 40, None), ("b", "GG", None)]
    assert max(len(r["value"]) for r in spark.read.text(str(tmp_path / "fa")).collect()) == 60


def test_generator_is_deterministic(spark):
    a, b = (generate.generate_reads(spark, 50, quality=k, seed=2, partitions=p) for k, p in (("degrading", 2), ("degrading", 5)))
    assert rows(a) == rows(b)
    for kind in (*generate.QUALITIES, None):
        assert generate.generate_reads(spark, 5, quality=kind).where("length(sequence) < 50").isEmpty()


def test_validation(spark):
    df = spark.createDataFrame([("a", "ACGT", "IIII"), ("", "AX", "I"), ("c", "A", "\x01")], "id string, sequence string, quality string")
    assert rows(validation.issue_rows(df)) == [("", "alphabet"), ("", "empty_id"), ("", "length_mismatch"), ("c", "quality_range")]
    assert validation.report(df).first()["num_issues"] == 4
    with pytest.raises(ValueError):
        validation.require_records(df.where("false"))


def test_power_log(spark, tmp_path):
    (tmp_path / "p.txt").write_text("CPU Power: 5 mW\n*** Sampled system activity (Sun Nov 2 18:42:35 2025 -0800)\nCPU Power: 70 mW\nx\nCPU Power: 80 mW\n")
    got = tables.read_power_log(spark, str(tmp_path / "p.txt")).collect()
    assert [r["cpu_power_mw"] for r in got] == [70.0, 80.0] and got[0]["timestamp"] == got[1]["timestamp"]


def test_power_log_in_splits(spark, tmp_path):
    """Readings find their header in any split before, and none in another file."""
    lines = ["CPU Power: 1 mW"]
    for i in range(20):
        lines += [f"*** Sampled system activity (Sun Nov 2 18:{i:02}:35 2025 -0800)", *["noise"] * (i % 3), *[f"CPU Power: {100 * i + j} mW" for j in range(i % 6)]]
    for k in range(2):
        (tmp_path / f"{k}.txt").write_text("\n".join(lines) + "\nCPU Power: 7 mW\n" * k)
    old, want = spark.conf.get("spark.sql.files.maxPartitionBytes"), None
    try:
        for size in ("128m", "300", "40"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((str(r["timestamp"]), r["cpu_power_mw"]) for r in tables.read_power_log(spark, str(tmp_path)).collect())
            want = want or got
            assert got == want and len(got) == 2 * sum(i % 6 for i in range(20)) + 1
            assert all(v == 7.0 or int(v) // 100 == int(t[14:16]) for t, v in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_plan_file(spark, tmp_path):
    (tmp_path / "c.toml").write_text('[[operations]]\nname = "a"\nimplemented = true\n[[operations]]\nname = "b"\n')
    assert rows(tables.read_plan(spark, str(tmp_path / "c.toml"))["operations"].select("name")) == [("a",), ("b",)]


def test_streams_equal_batches(spark, tmp_path):
    generate.generate_reads(spark, 200, quality="uniform_range", seed=4, partitions=4).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = pipelines.stream_parquet(spark, str(tmp_path / "in"), 1)
    pipelines.filter_pipeline(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    from strandlake.operators.quality import quality_filter_rows

    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(quality_filter_rows(batch))
    pipelines.complete_to(pipelines.running_counts(stream), str(tmp_path / "sum"), str(tmp_path / "c2")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "sum"))) == rows(pipelines.running_counts(batch))


def test_splits_of_larger_files(spark, monkeypatch):
    """Larger files have larger splits, not more of them, and the same reads."""
    from strandlake.plans import file_queries as Q

    assert Q.split_bytes(0, 1 << 27) == Q.split_bytes(1_000_000, 1 << 27) == Q.SPLIT
    assert -(-5_000_000_000 // Q.split_bytes(5_000_000_000, 1 << 27)) <= Q.SPLITS and Q.split_bytes(1 << 50, 1 << 27) == 1 << 27
    monkeypatch.setattr(Q, "SPLITS", 2)
    for name, n in (("fastq_stray_resync", 15_000), ("bgzf_files", 15_000)):
        df = Q.QUERIES[name](spark, "/root/testdata/sf0.01")
        assert df.rdd.getNumPartitions() <= 12 and df.count() == n
