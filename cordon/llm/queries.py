"""Registered queries of the subpackage and their SQL.

No SQL: benchmark tiling (1), licence cosine (2), graph search (3), bootstrapped patterns (4), fitted models (6, 9, 10), eigenvectors (12);
tests hold them against brute force, held-out accuracy or recall.
"""

from __future__ import annotations

from . import mixing, revisits
from .chat_roles import op10_chat_roles
from .decontaminate import op1_benchmark_tiling
from .hnsw import op3_hnsw
from .jaccard_join import ORACLE_SQL as JACCARD_SQL
from .jaccard_join import op8_ngram_jaccard
from .language_id import op9_language_fusion
from .licenses import op2_license_scan
from .merkle import ORACLE_SQL as MERKLE_SQL
from .merkle import op11_merkle_manifest
from .pii import op4_contextual_pii
from .quality import ORACLE_SQL as QUALITY_SQL
from .quality import op13_quality_divergence
from .toxicity import op6_toxicity_ordinal
from .whitening import op12_chebyshev_whitening

QUERIES = {
    "op1_benchmark_tiling": op1_benchmark_tiling,
    "op2_license_scan": op2_license_scan,
    "op3_hnsw": op3_hnsw,
    "op4_contextual_pii": op4_contextual_pii,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_toxicity_ordinal": op6_toxicity_ordinal,
    "op7_warc_revisits": revisits.op7_warc_revisits,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_language_fusion": op9_language_fusion,
    "op10_chat_roles": op10_chat_roles,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_chebyshev_whitening": op12_chebyshev_whitening,
    "op13_quality_divergence": op13_quality_divergence,
}

ORACLE: dict[str, str] = {
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op7_warc_revisits": revisits.ORACLE_SQL,
    "op8_ngram_jaccard": JACCARD_SQL,
    "op11_merkle_manifest": MERKLE_SQL,
    "op13_quality_divergence": QUALITY_SQL,
}
