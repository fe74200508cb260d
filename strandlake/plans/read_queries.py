"""Registered queries of the read operators, each with the SQL that it is compared with."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packed as P
from ..functions import sequence as S
from ..operators import counting, kmers, pairwise, quality, transforms, twobit
from ..schema import ADAPTER, ADAPTER_OVERLAP, EDIT_MAX, SKETCH_SIZE
from ..sources import fastq, validation
from ..streaming.pipelines import shared_folder
from .reads import MIXED_SQL, READS_SQL, adapter_sql, mixed, reads, with_adapter

QUERIES, SQL = {}, {}

#: Distance up to which the search lists pairs.
HAMMING_MOST = 36
K, SKETCH = 21, 16


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, source=reads):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(source(spark, sf_dir)))
        if sql:
            SQL[name] = sql
        return f

    return add


def _n(letters: str) -> str:
    both = letters + letters.lower()
    return f"coalesce(sum(length(sequence) - length(translate(sequence, '{both}', ''))), 0)::BIGINT"


_T = "coalesce(sum(strlen(sequence)), 0)::BIGINT"
_QUALS = "q AS (SELECT ord, unnest(range(1, length(quality) + 1)) AS pos, quality FROM reads WHERE quality IS NOT NULL), qv AS (SELECT ord, pos - 1 AS pos, ascii(substring(quality, pos, 1)) AS v FROM q)"
_MEANQ = "CASE WHEN quality IS NULL THEN NULL WHEN quality = '' THEN 0 ELSE list_sum(list_transform(string_split(quality, ''), lambda c: ascii(c)))::DOUBLE / length(quality) END"
_COMPLEX = "CASE WHEN sequence = '' THEN 0 ELSE len(list_distinct(string_split(sequence, '')))::DOUBLE / least(length(sequence), 4) END"


def _rate(a: str, b: str) -> str:
    return f"round(coalesce(100.0 * {a} / nullif({b}, 0), 0), 6)"


query("base_counting", f"WITH {MIXED_SQL} SELECT " + ", ".join(f"{_n(x.upper())} AS count_{x}" for x in "acgtn") + f", {_T} AS total FROM reads", mixed)(counting.base_counting)
query(
    "gc_content",
    f"WITH {MIXED_SQL}, t AS (SELECT {_n('G')} AS g, {_n('C')} AS c, {_n('AT')} AS w, {_n('N')} AS n, {_T} AS total FROM reads) SELECT g AS count_g, c AS count_c, g + c AS count_gc, w AS count_at, n AS count_n, total AS total_bases, {_rate('(g + c)', '(total - n)')} AS gc_percent FROM t",
    mixed,
)(counting.gc_content)
query("at_content", f"WITH {MIXED_SQL}, t AS (SELECT {_n('AT')} AS w, {_T} AS total FROM reads) SELECT w AS at_count, total AS total_bases, {_rate('w', 'total')} AS at_percent FROM t", mixed)(counting.at_content)
query(
    "n_content",
    f"WITH {MIXED_SQL}, t AS (SELECT {_n('N')} AS n, {_n('ACGT')} AS a, {_n('RYSWKMBDHV')} AS i, {_T} AS total FROM reads) SELECT n AS count_n, a AS count_acgt, i AS count_ambiguous, total - n - a - i AS count_other, total AS total_bases, {_rate('n', 'total')} AS n_percent FROM t",
    mixed,
)(counting.n_content)
query("sequence_length", f"WITH {MIXED_SQL} SELECT {_T} AS total_length, count(*) AS num_sequences, min(strlen(sequence))::BIGINT AS min_length, max(strlen(sequence))::BIGINT AS max_length, round(sum(strlen(sequence))::DOUBLE / count(*), 6) AS mean_length FROM reads", mixed)(counting.sequence_length)
query("complexity_score", f"WITH {MIXED_SQL}, t AS (SELECT {_COMPLEX} AS x FROM reads) SELECT count(*) AS total_sequences, count(*) FILTER (x < 0.4) AS low_complexity_count, count(*) FILTER (x > 0.7) AS high_complexity_count, round(avg(x), 6) AS mean_complexity FROM t", mixed)(counting.complexity_score)
query("read_statistics", f"WITH {MIXED_SQL} SELECT id, " + ", ".join(f"(length(sequence) - length(translate(sequence, '{x}{x.lower()}', '')))::BIGINT AS n_{k}" for k, x in {"a": "A", "c": "C", "g": "G", "t": "T", "n": "N", "iupac": "RYSWKMBDHV"}.items()) + f", strlen(sequence)::BIGINT AS n_total, round({_COMPLEX}, 6) AS complexity FROM reads", mixed)(counting.per_read)
query(
    "qc_report",
    f"WITH {MIXED_SQL}, p AS (SELECT *, {_COMPLEX} AS x, list_sum(list_transform(string_split(quality, ''), lambda c: ascii(c))) AS q FROM reads), t AS (SELECT count(*) AS num_sequences, {_T} AS total, "
    + ", ".join(f"{_n(x.upper())} AS {x}" for x in "acgtn")
    + f", min(strlen(sequence))::BIGINT AS min_length, max(strlen(sequence))::BIGINT AS max_length, count(*) FILTER (x < 0.4) AS low_complexity_count, sum(q)::DOUBLE AS q, sum(length(quality)) AS nq FROM p) SELECT num_sequences, total AS total_bases, a AS count_a, c AS count_c, g AS count_g, t AS count_t, n AS count_n, min_length, max_length, low_complexity_count, {_rate('(g + c)', '(total - n)')} AS gc_percent, {_rate('(a + t)', 'total')} AS at_percent, {_rate('n', 'total')} AS n_percent, round(q / nq, 6) AS mean_quality FROM t",
    mixed,
)(counting.qc_report)
query("dataset_characteristics", f"WITH {MIXED_SQL}, t AS (SELECT count(*) AS n, {_T} AS b, count(quality) AS q FROM reads) SELECT n AS num_sequences, b AS total_bases, CASE WHEN q > 0 THEN 'fastq' ELSE 'fasta' END AS format, CASE WHEN n < 1000 THEN 'tiny' WHEN n < 10000 THEN 'small' WHEN n < 100000 THEN 'medium' WHEN n < 1000000 THEN 'large' WHEN n < 10000000 THEN 'very_large' ELSE 'huge' END AS scale_category FROM t", mixed)(counting.dataset_characteristics)

for _name, _off in (("quality_aggregation", 0), ("quality_aggregation_phred", 33)):
    _v = f"greatest(v - {_off}, 0)"
    query(_name, f"WITH {MIXED_SQL}, {_QUALS} SELECT min({_v})::INTEGER AS min_quality, max({_v})::INTEGER AS max_quality, sum({_v})::BIGINT AS total_quality, count(*) AS num_bases, round(sum({_v})::DOUBLE / count(*), 6) AS mean_quality FROM qv", mixed)(lambda df, off=_off: quality.quality_aggregation(df, off))
_STATS = f"WITH {MIXED_SQL}, {_QUALS}, s AS (SELECT pos::INTEGER AS pos, sum(v)::DOUBLE / count(*) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(*) AS count FROM qv GROUP BY pos)"
query("quality_statistics", f"{_STATS} SELECT pos, round(mean, 6) AS mean, round(median, 6) AS median, round(q1, 6) AS q1, round(q3, 6) AS q3, count FROM s", mixed)(quality.quality_statistics)
query("quality_overall_mean", f"{_STATS} SELECT round(avg(mean), 6) AS overall_mean FROM s", mixed)(lambda df: quality.overall_mean(quality.quality_statistics(df)))
query("low_quality_positions", f"{_STATS} SELECT pos FROM s WHERE mean < 55", mixed)(lambda df: quality.low_quality_positions(quality.quality_statistics(df), 55))
query("quality_position", f"{_STATS} SELECT pos, round(mean, 6) AS mean, round(median, 6) AS median, round(q1, 6) AS q1, round(q3, 6) AS q3, count FROM s WHERE pos = 7", mixed)(lambda df: quality.position(quality.quality_statistics(df), 7))
query("quality_filter", f"WITH {MIXED_SQL}, m AS (SELECT {_MEANQ} AS m FROM reads), t AS (SELECT count(*) AS n, count(*) FILTER (m >= 54) AS p, count(*) FILTER (m < 54) AS f FROM m) SELECT n AS total_sequences, p AS passed_sequences, f AS filtered_sequences, {_rate('p', 'n')} AS pass_rate FROM t", mixed)(lambda df: quality.quality_filter(df, 54))
query("quality_filter_rows", f"WITH {MIXED_SQL} SELECT id, sequence, quality FROM reads WHERE {_MEANQ} - 33 >= 20", mixed)(lambda df: quality.quality_filter_rows(df).select("id", "sequence", "quality"))
query("quality_mask", f"WITH {MIXED_SQL} SELECT id, CASE WHEN {_MEANQ} >= 54 THEN 1 ELSE 0 END AS passes FROM reads", mixed)(lambda df: quality.quality_mask(df, 54).select("id", "passes"))
query("length_filter", f"WITH {MIXED_SQL}, t AS (SELECT count(*) AS n, count(*) FILTER (length(sequence) >= 50) AS p FROM reads) SELECT n AS total_sequences, p AS passed_sequences, n - p AS filtered_sequences, {_rate('p', 'n')} AS pass_rate FROM t", mixed)(quality.length_filter)
query("length_range", f"WITH {MIXED_SQL} SELECT id, sequence FROM reads WHERE length(sequence) BETWEEN 20 AND 40", mixed)(lambda df: quality.length_range(df, 20, 40).select("id", "sequence"))

query("reverse_complement", f"WITH {MIXED_SQL} SELECT concat(id, '_revcomp') AS id, reverse(translate(regexp_replace(sequence, '[^ACGTNacgtn]', 'N', 'g'), 'ACGTacgt', 'TGCAtgca')) AS sequence FROM reads", mixed)(lambda df: transforms.reverse_complement(df).select("id", "sequence"))
_MASK = "CASE WHEN quality IS NULL THEN sequence ELSE array_to_string(list_transform(range(1, length(sequence) + 1), lambda i: CASE WHEN ascii(substring(quality, i, 1)) < 53 THEN 'N' ELSE substring(sequence, i, 1) END), '') END"
query("sequence_masking", f"WITH {MIXED_SQL} SELECT id, {_MASK} AS sequence, quality FROM reads", mixed)(transforms.sequence_masking)
query("masking_stats", f"WITH {MIXED_SQL}, m AS (SELECT sequence AS a, {_MASK} AS b FROM reads), t AS (SELECT sum(strlen(a))::BIGINT AS n, sum(len(list_filter(range(1, length(a) + 1), lambda i: substring(a, i, 1) <> substring(b, i, 1) AND substring(b, i, 1) = 'N')))::BIGINT AS k FROM m) SELECT n AS total_bases, k AS masked_bases, {_rate('k', 'n')} AS masked_percentage FROM t", mixed)(lambda df: transforms.masking_stats(df, transforms.sequence_masking(df)))
_AT = f"instr(sequence, '{ADAPTER[:ADAPTER_OVERLAP]}')"
query(
    "adapter_trimming",
    f"WITH {adapter_sql(ADAPTER)}, t AS (SELECT *, {_AT} AS p FROM reads) SELECT CASE WHEN p > 0 THEN concat(id, '_trimmed') ELSE id END AS id, CASE WHEN p > 0 THEN substring(sequence, 1, p - 1) ELSE sequence END AS sequence, CASE WHEN p > 0 THEN substring(quality, 1, p - 1) ELSE quality END AS quality FROM t WHERE p = 0 OR p - 1 >= 10",
    lambda spark, sf_dir: with_adapter(spark, sf_dir, ADAPTER),
)(lambda df: transforms.adapter_trimming(df, least=10))
_CODONS = ", ".join(f"('{''.join(c)}', '{a}')" for c, a in zip(product("TCAG", repeat=3), S.AMINO_ACIDS, strict=True))
for _f in range(3):
    query(
        f"translation_f{_f}",
        f"WITH {READS_SQL}, codons(codon, aa) AS (VALUES {_CODONS}), c AS (SELECT id, i, substring(sequence, i * 3 + {1 + _f}, 3) AS codon FROM reads, range(0, 21) AS r(i) WHERE i * 3 + {3 + _f} <= length(sequence)), p AS (SELECT id, string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS s FROM c LEFT JOIN codons USING (codon) GROUP BY id) SELECT concat(id, '_frame{_f}') AS id, split_part(s, '*', 1) AS sequence FROM p WHERE length(split_part(s, '*', 1)) >= 1",
    )(lambda df, f=_f: transforms.translation(df, f).select("id", "sequence"))
query("default_quality", f"WITH {MIXED_SQL} SELECT id, sequence, coalesce(quality, repeat('?', length(sequence))) AS quality FROM reads", mixed)(lambda df: transforms.with_default_quality(df).select("id", "sequence", "quality"))

_WINDOWS = "w AS (SELECT id, quality, unnest(range(1, length(sequence) - {k} + 2)) AS i, sequence FROM reads), k AS (SELECT id, quality, i - 1 AS i, substring(sequence, i, {k}) AS kmer FROM w)"
_W21, _W9, _W5, _W3 = (_WINDOWS.format(k=k) for k in (K, 9, 5, 3))
_CLEAN = "regexp_full_match(kmer, '[ACGT]+')"
query("kmer_extraction", f"WITH {READS_SQL}, {_W9} SELECT concat(id, '_kmer_', cast(i AS varchar)) AS id, kmer AS sequence, substring(quality, i + 1, 9) AS quality FROM k WHERE {_CLEAN}")(lambda df: kmers.kmer_extraction(df, 9))
query("kmer_extraction_dedup", f"WITH {READS_SQL}, {_W3}, f AS (SELECT *, row_number() OVER (PARTITION BY id, kmer ORDER BY i) AS r FROM k WHERE {_CLEAN}) SELECT concat(id, '_kmer_', cast(i AS varchar)) AS id, kmer AS sequence FROM f WHERE r = 1")(lambda df: kmers.kmer_extraction(df, 3, True).select("id", "sequence"))
query("kmer_counting", f"WITH {READS_SQL}, {_W5} SELECT kmer, count(*) AS count FROM k WHERE {_CLEAN} GROUP BY kmer")(lambda df: kmers.kmer_counting(df, 5))
query("kmer_counting_canonical", f"WITH {READS_SQL}, {_W5} SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS count FROM k WHERE {_CLEAN} GROUP BY 1")(lambda df: kmers.kmer_counting(df, 5, True))
query("kmer_totals", f"WITH {READS_SQL}, {_W9} SELECT count(*) AS total_kmers, count(DISTINCT kmer) AS unique_kmers FROM k WHERE {_CLEAN}")(lambda df: kmers.kmer_totals(kmers.kmer_counting(df, 9)))
query("kmer_distinct", f"WITH {MIXED_SQL}, {_W5} SELECT count(DISTINCT kmer) AS distinct_kmers FROM k", mixed)(kmers.kmer_distinct)
query("adapter_presence", f"WITH {adapter_sql(ADAPTER)} SELECT count(*) AS total_sequences, count(*) FILTER (contains(sequence, '{ADAPTER}')) AS with_adapter FROM reads", lambda spark, sf_dir: with_adapter(spark, sf_dir, ADAPTER))(lambda df: kmers.adapter_presence(df, ADAPTER))

_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(kmer, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
_SKETCHES = f"{_W21}, h AS (SELECT id, {_FNV} AS h FROM k WHERE {_CLEAN}), s AS (SELECT r.id, coalesce(list(h ORDER BY h) FILTER (h IS NOT NULL), []) AS hs FROM reads r LEFT JOIN h USING (id) GROUP BY r.id)"
query("minhash_sketch", f"WITH {READS_SQL}, {_SKETCHES} SELECT id AS sequence_id, array_to_string(list_transform(hs[1:{SKETCH}], lambda x: cast(x AS varchar)), ',') AS sketch, len(hs[1:{SKETCH}])::INTEGER AS sketch_size, {K} AS k FROM s")(
    lambda df: kmers.minhash_sketching(df, K, SKETCH).withColumn("sketch", F.array_join(F.transform("sketch", lambda x: x.cast("string")), ","))
)
_FNV5 = f"h AS (SELECT id, {_FNV} AS h FROM k WHERE {_CLEAN}), g AS (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY h) AS r FROM h), c AS (SELECT id, h, count(*) AS n FROM g WHERE r <= {SKETCH} GROUP BY id, h)"


def _neighbours(df: DataFrame, size: int = SKETCH) -> DataFrame:
    """Each read's sketch with the next one's, by order key."""
    shifted = df.select(F.col("id").alias("a"), F.concat(F.lit("seq_"), (F.col("ord") + 1).cast("string")).alias("b"))
    return kmers.jaccard_similarity(kmers.minhash_sketching(df, 5, size), shifted)


query(
    "minhash_jaccard",
    f"WITH {READS_SQL}, {_W5}, {_FNV5}, p AS (SELECT x.id AS a, y.id AS b FROM reads x JOIN reads y ON y.ord = x.ord + 1), m AS (SELECT p.a, p.b, h, coalesce(sum(n) FILTER (c.id = p.a), 0) AS x, coalesce(sum(n) FILTER (c.id = p.b), 0) AS y FROM p JOIN c ON c.id = p.a OR c.id = p.b GROUP BY p.a, p.b, h), j AS (SELECT a, b, sum(least(x, y))::DOUBLE / sum(greatest(x, y)) AS s FROM m GROUP BY a, b) SELECT p.a, p.b, round(coalesce(s, 0), 6) AS similarity FROM p LEFT JOIN j USING (a, b)".replace("c ON c.id = p.a OR c.id = p.b", "(SELECT p.a, p.b, c.id, h, n FROM p JOIN c ON c.id = p.a UNION ALL SELECT p.a, p.b, c.id, h, n FROM p JOIN c ON c.id = p.b) c ON c.a = p.a AND c.b = p.b"),
)(_neighbours)
SQL["minhash_jaccard_1000"] = SQL["minhash_jaccard"].replace(f"r <= {SKETCH} ", f"r <= {SKETCH_SIZE} ")
query("minhash_jaccard_1000", SQL["minhash_jaccard_1000"])(lambda df: _neighbours(df, SKETCH_SIZE))

# Queries are the reads whose key is divisible by 20; they are compared with all reads.
_HAMMING = f"WITH {READS_SQL}, d AS (SELECT x.ord AS i, y.ord AS j, hamming(x.sequence, y.sequence)::BIGINT AS distance FROM reads x JOIN reads y ON x.ord % 20 = 0 AND x.ord <> y.ord)"
query("hamming_pairs", f"{_HAMMING} SELECT i, j, distance FROM d WHERE distance <= {HAMMING_MOST}")(lambda df: pairwise.hamming_search(df.where("ord % 20 = 0"), df, HAMMING_MOST))
query("hamming_summary", f"{_HAMMING} SELECT count(*) AS num_pairs, min(distance) AS min_distance, max(distance) AS max_distance, round(avg(distance), 6) AS mean_distance FROM d")(lambda df: pairwise.hamming_summary(df, df.where("ord % 20 = 0")))
query("edit_pairs", f"WITH {MIXED_SQL}, f AS (SELECT * FROM reads ORDER BY ord LIMIT {EDIT_MAX}) SELECT x.ord AS i, y.ord AS j, levenshtein(x.sequence, y.sequence)::BIGINT AS distance FROM f x JOIN f y ON x.ord < y.ord", mixed)(pairwise.edit_distance)

_BITS = "regexp_replace(upper(sequence), '[^ACGT]', 'A', 'g')"
_ENC = f"array_to_string(list_transform(range(0, ((length(sequence) + 3) // 4) * 2), lambda i: substring('0123456789ABCDEF', 1 + 4 * (instr('ACGT', substring(rpad({_BITS}, 64, 'A'), (2 * i + 1)::INTEGER, 1)) - 1) + instr('ACGT', substring(rpad({_BITS}, 64, 'A'), (2 * i + 2)::INTEGER, 1)) - 1, 1)), '')"
query("encode_2bit", f"WITH {MIXED_SQL} SELECT id, {_ENC} AS data_hex, length(sequence)::INTEGER AS length FROM reads", mixed)(lambda df: df.select("id", P.encode(F.col("sequence")).alias("p")).select("id", F.hex("p.data").alias("data_hex"), "p.length"))
query("decode_2bit", f"WITH {MIXED_SQL} SELECT id, {_BITS} AS sequence FROM reads", mixed)(lambda df: df.select("id", P.decode(P.encode(F.col("sequence"))).alias("sequence")))
query("get_2bit", f"WITH {MIXED_SQL} SELECT id, CASE WHEN length(sequence) > 9 THEN substring({_BITS}, 10, 1) END AS base FROM reads", mixed)(lambda df: df.select("id", P.get(P.encode(F.col("sequence")), F.lit(9)).alias("base")))
query("complement_2bit", f"WITH {MIXED_SQL} SELECT id, translate({_BITS}, 'ACGT', 'TGCA') AS complement, reverse(translate({_BITS}, 'ACGT', 'TGCA')) AS reverse_complement FROM reads", mixed)(
    lambda df: df.select("id", P.encode(F.col("sequence")).alias("p")).select("id", P.decode(P.complement(F.col("p"))).alias("complement"), P.decode(P.reverse_complement(F.col("p"))).alias("reverse_complement"))
)
_TWOBIT = f"WITH {MIXED_SQL}, t AS (SELECT ord, {_BITS} AS sequence FROM reads)"
query("twobit_base_count", f"{_TWOBIT} SELECT " + ", ".join(f"{_n(x.upper())} AS count_{x}" for x in "acgtn") + f", {_T} AS total FROM t", mixed)(lambda df: twobit.base_counting(twobit.packed(df)))
query("twobit_gc", f"{_TWOBIT}, c AS (SELECT {_n('GC')} AS gc, {_T} AS total FROM t) SELECT gc AS count_gc, total AS total_bases, {_rate('gc', 'total')} AS gc_percent FROM c", mixed)(lambda df: twobit.gc_content(twobit.packed(df)))
query("twobit_at", f"{_TWOBIT}, c AS (SELECT {_n("AT")} AS w, {_T} AS total FROM t) SELECT w AS at_count, total AS total_bases, {_rate("w", "total")} AS at_percent FROM c", mixed)(lambda df: twobit.at_content(twobit.packed(df)))
query("twobit_length", f"{_TWOBIT} SELECT {_T} AS total_length, count(*) AS num_sequences, min(strlen(sequence))::BIGINT AS min_length, max(strlen(sequence))::BIGINT AS max_length, round(sum(strlen(sequence))::DOUBLE / count(*), 6) AS mean_length FROM t", mixed)(lambda df: twobit.sequence_length(twobit.packed(df)))
query("twobit_reverse_complement", f"{_TWOBIT} SELECT concat('seq', cast(ord AS varchar), '_revcomp') AS id, reverse(translate(sequence, 'ACGT', 'TGCA')) AS sequence FROM t", mixed)(
    lambda df: twobit.reverse_complement(twobit.packed(df.withColumn("id", F.concat(F.lit("seq"), F.col("ord").cast("string"))))).select("id", P.decode(F.col("packed")).alias("sequence"))
)

query("fastq_roundtrip", f"WITH {MIXED_SQL} SELECT id, sequence, coalesce(quality, repeat('?', length(sequence))) AS quality FROM reads", mixed)(fastq.round_trip)
query("fastq_text", f"WITH {READS_SQL} SELECT concat('@', id, chr(10), sequence, chr(10), '+', chr(10), quality) AS value FROM reads")(fastq.fastq_text)
query("validate_fastq", f"WITH {MIXED_SQL} SELECT 'fastq' AS file_format, count(*) AS num_records, min(length(sequence)) AS min_length, max(length(sequence)) AS max_length, round(avg(length(sequence)), 6) AS mean_length, count(*) FILTER (NOT regexp_full_match(sequence, '[ACGTNacgtn]*')) AS num_issues FROM reads", mixed)(validation.report)
query("validation_issues", f"WITH {MIXED_SQL} SELECT id, 'alphabet' AS issue FROM reads WHERE NOT regexp_full_match(sequence, '[ACGTNacgtn]*')", mixed)(validation.issue_rows)


def _stored(df: DataFrame, write) -> str:
    """Where the reads were written, in a new shared folder."""
    path = f"{shared_folder(df.sparkSession)}/reads"
    write(df, path)
    return path


_FILLED = f"WITH {MIXED_SQL} SELECT id, sequence, coalesce(quality, repeat('?', length(sequence))) AS quality FROM reads"
_BAD = "NOT regexp_full_match(sequence, '[ACGTNacgtn]*')"
query("fastq_plain_files", _FILLED, mixed)(lambda df: fastq.read_fastq(df.sparkSession, _stored(df, lambda d, p: fastq.write_fastq(d, p, "none")), compression="none"))
query("fastq_gzip_files", _FILLED, mixed)(lambda df: fastq.read_fastq(df.sparkSession, _stored(df, fastq.write_fastq)))
query("fastq_resync_files", _FILLED, mixed)(lambda df: fastq.read_fastq(df.sparkSession, _stored(df, fastq.write_fastq), mode="RESYNC"))
query("fasta_files", f"WITH {MIXED_SQL} SELECT id, sequence FROM reads", mixed)(lambda df: fastq.read_fasta(df.sparkSession, _stored(df, fastq.write_fasta)).select("id", "sequence"))
query("fastq_malformed_files", f"WITH {MIXED_SQL} SELECT id, sequence, coalesce(quality, repeat('?', length(sequence))) AS quality FROM reads WHERE ord % 3 <> 0", mixed)(
    lambda df: fastq.read_fastq(df.sparkSession, _stored(df.withColumn("quality", F.when(F.col("ord") % 3 == 0, F.concat("sequence", F.lit("!"))).otherwise(F.col("quality"))), fastq.write_fastq), mode="DROPMALFORMED")
)
query("fastq_file_report", f"WITH {MIXED_SQL} SELECT 'fastq' AS file_format, count(*) AS num_records, min(length(sequence)) AS min_length, max(length(sequence)) AS max_length, round(avg(length(sequence)), 6) AS mean_length, count(*) FILTER ({_BAD}) AS num_issues FROM reads", mixed)(
    lambda df: validation.file_report(validation.file_records(df.sparkSession, _stored(df, fastq.write_fastq)))
)
query("fasta_file_issues", f"WITH {MIXED_SQL} SELECT 'alphabet' AS issue, count(*) AS n FROM reads WHERE {_BAD}", mixed)(
    lambda df: validation.file_issues(validation.file_records(df.sparkSession, _stored(df, fastq.write_fasta), "fasta")).groupBy("issue").agg(F.count("*").alias("n"))
)


def _end_to_end(df: DataFrame) -> DataFrame:
    """Compressed FASTQ in, filtered by quality, compressed FASTQ out; counts of both sides."""
    spark = df.sparkSession
    source = fastq.read_fastq(spark, _stored(df, fastq.write_fastq))
    out = fastq.read_fastq(spark, _stored(quality.quality_filter_rows(source), fastq.write_fastq))
    counted = lambda x: counting.base_counting(x).select("total", "count_n")
    sizes = lambda x: x.agg(F.count("*").alias("n"))
    return counted(source).select(F.lit("in").alias("side"), "*").join(sizes(source)).union(counted(out).select(F.lit("out").alias("side"), "*").join(sizes(out)))


query(
    "gzip_count_filter",
    f"WITH {READS_SQL}, k AS (SELECT * FROM reads WHERE {_MEANQ} - 33 >= 20) " + " UNION ALL ".join(f"SELECT '{side}' AS side, {_T} AS total, {_n('N')} AS count_n, count(*) AS n FROM {t}" for side, t in (("in", "reads"), ("out", "k"))),
)(_end_to_end)
