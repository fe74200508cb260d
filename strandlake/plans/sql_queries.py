"""Registered queries written in SQL over the library's own SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.sql import register
from .read_queries import SQL as READ_SQL
from .reads import MIXED_SQL, mixed, reads

QUERIES, SQL = {}, {}


def query(name: str, text: str, oracle: str, source=reads):
    """A text run in a session of its own, in which `reads` is a view and the functions are registered."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            own.conf.set(key, spark.conf.get(key))
        register(own)
        source(own, sf_dir).createOrReplaceTempView("reads")
        return own.sql(text)

    QUERIES[name], SQL[name] = run, oracle


query("sql_kmers", "SELECT kmer, count(*) AS count FROM kmers(TABLE(SELECT id, sequence FROM reads), 5) GROUP BY kmer", READ_SQL["kmer_counting"])
query(
    "sql_kmer_places",
    "SELECT place, count(*) AS n, count(DISTINCT kmer) AS n_kmers FROM kmers(TABLE(SELECT id, sequence FROM reads), 9) GROUP BY place",
    f"WITH {MIXED_SQL}, k AS (SELECT unnest(range(0, greatest(0, length(sequence) - 8))) AS place, sequence FROM reads), w AS (SELECT place, substring(sequence, (place + 1)::INTEGER, 9) AS kmer FROM k) SELECT place::BIGINT AS place, count(*) AS n, count(DISTINCT kmer) AS n_kmers FROM w WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY place",
    mixed,
)
query(
    "sql_least_hashes",
    "SELECT id, hash FROM least_hashes(TABLE(SELECT id, sequence FROM reads), 21)",
    f"SELECT sequence_id AS id, split_part(sketch, ',', 1) AS hash FROM ({READ_SQL['minhash_sketch']}) WHERE sketch_size > 0",
)
query(
    "sql_read_functions",
    "SELECT id, reverse_complement(sequence) AS turned, count_letters(sequence, 'GC') AS count_gc, round(gc_percent(sequence), 6) AS gc_percent, round(complexity(sequence), 6) AS complexity, round(mean_quality(quality), 6) AS mean_quality, adapter_position(sequence, 'AC') AS position, decode_2bit(reverse_complement_2bit(encode_2bit(sequence))) AS turned_2bit FROM reads",
    f"WITH {MIXED_SQL}, t AS (SELECT *, length(sequence) - length(translate(sequence, 'GCgc', '')) AS gc, length(sequence) - length(translate(sequence, 'Nn', '')) AS n, regexp_replace(upper(sequence), '[^ACGT]', 'A', 'g') AS four FROM reads) "
    "SELECT id, reverse(translate(regexp_replace(sequence, '[^ACGTNacgtn]', 'N', 'g'), 'ACGTacgt', 'TGCAtgca')) AS turned, gc::BIGINT AS count_gc, round(coalesce(100.0 * gc / nullif(length(sequence) - n, 0), 0), 6) AS gc_percent, "
    "round(len(list_distinct(string_split(sequence, '')))::DOUBLE / least(length(sequence), 4), 6) AS complexity, round(CASE WHEN quality IS NOT NULL THEN list_sum(list_transform(string_split(quality, ''), lambda c: ascii(c)))::DOUBLE / length(quality) END, 6) AS mean_quality, "
    "instr(sequence, 'AC')::INTEGER AS position, reverse(translate(four, 'ACGT', 'TGCA')) AS turned_2bit FROM t",
    mixed,
)
