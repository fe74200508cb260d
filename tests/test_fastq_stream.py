"""The stream of growing FASTQ files: where records begin and end, growth between runs, and restarts."""

import io
import random

import pytest

from strandlake.operators.quality import quality_filter_rows
from strandlake.sources import fastq
from strandlake.streaming import fastq_source, pipelines


def records(n, seed=0, longest=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        size = r.randrange(longest)
        out.append((f"s{seed}r{i}", "".join(r.choices("ACGTN", k=size)), "".join(r.choices("@+I5~", k=size))))
    return out


def text_of(rows):
    return "".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in rows).encode()


def test_places(monkeypatch):
    """From every byte the next record's start is found, and from every length the end of the whole records."""
    monkeypatch.setattr(fastq_source, "LOOK", 40)
    rows = records(30, 4, 25)
    data, ends = text_of(rows), [0]
    for row in rows:
        ends.append(ends[-1] + len(text_of([row])))
    f = io.BytesIO(data)
    for place in range(len(data) + 1):
        assert fastq_source.record_at(f, place, 0, len(data)) == next(e for e in ends if e >= place)
        assert fastq_source.end_of_records(io.BytesIO(data[:place]), place) == max(e for e in ends if e <= place)


def test_ranges_hold_each_record_once(tmp_path):
    rows = records(80, 1) + records(3, 2, 5000) + records(40, 3)
    (tmp_path / "a.fq").write_bytes(text_of(rows))
    for size in (1, 50, 777, 1 << 20):
        reader = fastq_source.GrowingReader({"path": str(tmp_path), "partitionbytes": str(size)})
        got = [tuple(r.values()) for part in reader.partitions({}, reader.latestOffset()) for b in reader.read(part) for r in b.to_pylist()]
        assert got == rows


def test_growth_and_restart(spark, tmp_path):
    """Three runs of one query over files that grow, by part of a record too, and appear: all records, each once."""
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    a, b, c = (records(50, k) for k in range(3))
    whole = text_of(a)
    steps = [{"a.fq": whole[: len(whole) // 3]}, {"a.fq": whole[: -7], "b.fq": text_of(b)}, {"a.fq": whole, "c.fq": text_of(c), "_hidden": b"no"}]
    counts = []
    for step in steps:
        for name, data in step.items():
            (source / name).write_bytes(data)
        pipelines.filter_pipeline(fastq_source.stream_fastq(spark, str(source), 900), out, checkpoint, least=0.0).awaitTermination()
        counts.append(spark.read.parquet(out).count())
    batch = quality_filter_rows(fastq.read_fastq(spark, str(source / "*.fq")), 0.0)
    assert sorted(map(tuple, spark.read.parquet(out).select("id", "sequence", "quality").collect())) == sorted(map(tuple, batch.select("id", "sequence", "quality").collect()))
    assert 0 < counts[0] < counts[1] < counts[2]


def test_malformed_growth_fails(tmp_path):
    (tmp_path / "a.fq").write_bytes(text_of(records(5)) + b"stray\n" + text_of(records(5)))
    reader = fastq_source.GrowingReader({"path": str(tmp_path)})
    with pytest.raises(ValueError):
        [b for part in reader.partitions({}, reader.latestOffset()) for b in reader.read(part)]
