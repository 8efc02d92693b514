"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyscope.llm import hard_negatives, licenses, prefix_trie
from tallyscope.llm.collision_search import op1_collision_search
from tallyscope.llm.fingerprints import op6_fingerprints
from tallyscope.llm.langid import op8_langid
from tallyscope.llm.ngram_join import op2_ngram_join
from tallyscope.llm.packing import op10_packing
from tallyscope.llm.pii import op4_pii
from tallyscope.llm.sentencepiece_codec import op3_sentencepiece
from tallyscope.llm.simhash_bktree import op13_simhash_bktree
from tallyscope.llm.suffix_dedup import op9_suffix_dedup
from tallyscope.llm.toxicity import op5_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_collision_search": op1_collision_search,
        "op2_ngram_join": op2_ngram_join,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_pii": op4_pii,
        "op5_toxicity": op5_toxicity,
        "op6_fingerprints": op6_fingerprints,
        "op7_licenses": licenses.op7_licenses,
        "op8_langid": op8_langid,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_packing": op10_packing,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_simhash_bktree": op13_simhash_bktree,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_licenses": licenses.oracle(),
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op12_hard_negatives": hard_negatives.ORACLE,
    }
