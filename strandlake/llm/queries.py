"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .decontaminate import op1_decontamination
from .embeddings import op9_embeddings
from .fim import op11_fim
from .langid import op8_language_id
from .licenses import op13_licenses
from .minhash import op7_minhash
from .oracle import ORACLE_SQL
from .pii import op6_pii
from .quality import op3_quality
from .resample import op12_resampling
from .secrets import op10_secrets
from .sharding import op2_sharding
from .substrings import op5_substrings

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_substrings": op5_substrings,
    "op6_pii": op6_pii,
    "op7_minhash": op7_minhash,
    "op8_language_id": op8_language_id,
    "op9_embeddings": op9_embeddings,
    "op10_secrets": op10_secrets,
    "op11_fim": op11_fim,
    "op12_resampling": op12_resampling,
    "op13_licenses": op13_licenses,
}
