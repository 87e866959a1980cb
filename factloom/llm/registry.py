"""Queries of this package, by the names that __spark_entry__.py gives out."""

from .fingerprints import op4_imatch_fingerprints
from .neardup import op3_minhash_neardup
from .packing import op10_packing
from .quality import op5_quality_fm
from .sharding import op1_kdtree_sharding
from .tokens import op6_token_counts, op8_bpe_codec
from .toxicity import op7_toxicity_lexicon
from .urls import OP2_SQL, op2_url_filter
from .vectors import op9_embedding_neardup

QUERIES = {
    f.__name__: f
    for f in (op1_kdtree_sharding, op2_url_filter, op3_minhash_neardup, op4_imatch_fingerprints, op5_quality_fm, op6_token_counts, op7_toxicity_lexicon, op8_bpe_codec, op9_embedding_neardup, op10_packing)
}
#: The others can't be written in SQL (models, tokenizers, sketches, an iterated tree); tests hold them against brute force.
ORACLE_SQL = {"op2_url_filter": OP2_SQL}
