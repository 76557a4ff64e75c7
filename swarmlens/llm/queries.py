"""The queries of this subpackage and their SQL, for the entry module."""

from swarmlens.llm.ann import op5_ann
from swarmlens.llm.byte_bpe import op2_byte_bpe
from swarmlens.llm.centroid_trees import OP12_SQL, op12_dual_tree
from swarmlens.llm.fingerprints import op6_fingerprints
from swarmlens.llm.language_id import op3_language_id
from swarmlens.llm.lm_scoring import op7_lm_scoring
from swarmlens.llm.mixing import OP9_SQL, op9_mixing
from swarmlens.llm.near_vectors import OP11_SQL, op11_vector_dedup
from swarmlens.llm.ngram_join import OP10_SQL, op10_ngram_join
from swarmlens.llm.session import shared_checkpoints
from swarmlens.llm.sharding import OP8_SQL, op8_sharding
from swarmlens.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from swarmlens.llm.url_filter import OP4_SQL, op4_url_filter
from swarmlens.llm.whitening import op13_whitening


def _prepared(query):
    def run(spark, sf_dir):
        shared_checkpoints(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    q.__name__: _prepared(q)
    for q in (op1_substring_dedup, op2_byte_bpe, op3_language_id, op4_url_filter, op5_ann, op6_fingerprints, op7_lm_scoring, op8_sharding, op9_mixing, op10_ngram_join, op11_vector_dedup, op12_dual_tree, op13_whitening)
}
ORACLE_SQL = {"op1_substring_dedup": OP1_SQL, "op4_url_filter": OP4_SQL, "op8_sharding": OP8_SQL, "op9_mixing": OP9_SQL, "op10_ngram_join": OP10_SQL, "op11_vector_dedup": OP11_SQL, "op12_dual_tree": OP12_SQL}
