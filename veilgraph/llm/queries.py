"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op8_ivfpq
from .bpe_trie import op7_bpe_trie
from .embed_dedup import op6_multi_index
from .language import op5_zstd_language
from .packing import op10_best_fit
from .pii import op9_pii
from .sharding import op4_rendezvous
from .simhash import op3_simhash
from .token_files import op1_token_files
from .toxicity import op2_nb_ngrams

QUERIES = {f.__name__: f for f in (op1_token_files, op2_nb_ngrams, op3_simhash, op4_rendezvous, op5_zstd_language, op6_multi_index, op7_bpe_trie, op8_ivfpq, op9_pii, op10_best_fit)}
#: None: tokenizer ids, fitted models, XXH64 and leftmost regex spans have no DuckDB SQL; tests hold these against brute force.
ORACLE_SQL: dict[str, str] = {}
