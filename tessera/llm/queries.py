"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm.iblt import op7_iblt_fingerprints
from tessera.llm.langid import op3_hyperdimensional_langid
from tessera.llm.minhash_join import op10_minhash_jaccard_join
from tessera.llm.mixing import op2_entropy_balancing
from tessera.llm.packing import op4_best_fit_packing
from tessera.llm.quality import op5_adaptive_quality
from tessera.llm.sanitise import op9_information_theoretic_pii
from tessera.llm.sitetree import op8_site_style_tree
from tessera.llm.sql import ORACLE_SQL
from tessera.llm.suffix_lm import op1_suffix_tree_scores
from tessera.llm.warc import op6_sharded_warc

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_suffix_tree_scores": op1_suffix_tree_scores,
    "op2_entropy_balancing": op2_entropy_balancing,
    "op3_hyperdimensional_langid": op3_hyperdimensional_langid,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_adaptive_quality": op5_adaptive_quality,
    "op6_sharded_warc": op6_sharded_warc,
    "op7_iblt_fingerprints": op7_iblt_fingerprints,
    "op8_site_style_tree": op8_site_style_tree,
    "op9_information_theoretic_pii": op9_information_theoretic_pii,
    "op10_minhash_jaccard_join": op10_minhash_jaccard_join,
}
