"""The stages, one by one, against brute force."""

import re

import corpus_pipeline
import numpy as np
from strandlake.llm import decontaminate, secrets
from strandlake.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import brute_near, brute_secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, hard_rows, tmp_path):
    from .conftest import SCHEMA

    extra = [(300, "leak " + spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"] + " end", "en", "s", 9), (301, "my token = abcdefghijklmnop123 is in these plain words about nothing", "en", "s", 9)]
    docs = spark.createDataFrame([*hard_rows, *extra], SCHEMA)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == docs.columns
        kept = {r["doc_id"] for r in after.collect()}
        gone = {r["doc_id"] for r in before} - kept
        if k == 0:
            assert gone == {90, 91, 92, 95}
        if k == 1:
            rows = [(r["doc_id"], r["text"]) for r in before]
            assert gone == {i for i, _, _, keep in brute_near(rows, 5) if not keep and i is not None}
        if k == 2:
            assert gone == {300}
        if k == 3:
            assert not gone
            assert all(not brute_secrets(r["text"]) for r in after.collect() if r["doc_id"] != 97)
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
            assert secrets.MASK in next(r["text"] for r in after.collect() if r["doc_id"] == 301)
        if k == 4:
            assert after.count() == len(before)
        docs = after


def test_stages_keep_columns_that_clash(spark, hard):
    """Columns named like those used inside come back as they were."""
    from pyspark.sql import functions as F

    docs = hard.select("*", *[F.lit("mine").alias(c) for c in ("_language", "_leaks", "lang_pred", "component_id", "kept", "masked", "_blocks", "_own", "virtual_slot")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        assert rows and all(r["_language"] == r["_leaks"] == r["kept"] == "mine" and r["node"] == "clash" for r in rows)


def test_run(spark):
    """The whole run over a table equals the plain filters one after the other, and its tokens are those of the texts left."""
    import base64
    import hashlib

    import public_tokenizers as P
    import tiktoken

    from strandlake.llm import bpe, langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = langid.learn(docs.where(~langid.held_out(docs["doc_id"], 3, 1)))
    left = [r for r in docs.collect() if r["text"] is not None]
    found = {r["doc_id"]: profiles.predict(np.frombuffer(r["text"].encode(), np.uint8)) for r in left}
    left = [r for r in left if found[r["doc_id"]][0] != langid.UNKNOWN and found[r["doc_id"]][1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    kept = {i for i, _, _, keep in brute_near([(r["doc_id"], r["text"]) for r in left], 5) if keep}
    left = [r for r in left if r["doc_id"] in kept]
    table = spark.createDataFrame([(r["doc_id"], r["text"]) for r in left], "doc_id long, text string")
    leaks = {r["doc_id"] for r in decontaminate.contaminated(table, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    left = [r for r in left if r["doc_id"] not in leaks]
    table = spark.createDataFrame(left, docs.schema)
    masked = corpus_pipeline.mask_secrets(spark, table, SF).select("doc_id", "text").collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in masked:
        ids = own.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(want) and 0 < len(got) < docs.count()


def test_stages_on_empty_tables(spark, hard):
    docs = hard.where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.isEmpty() and (k == 4 or out.columns == docs.columns)


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
    assert decontaminate.SHINGLE == corpus_pipeline.SHINGLE_WORDS == 5
