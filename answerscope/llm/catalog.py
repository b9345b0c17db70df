"""The operators' queries and, where SQL can express one, its SQL."""

from .credentials import OP6_SQL, op6_secret_scan
from .decontamination import OP9_SQL, op9_benchmark_suffixes
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .html_main import op7_html_subsequence
from .language import op5_language_ecoc
from .licenses import OP4_SQL, op4_license_rules
from .media import op1_media_wav
from .packing import op10_packing
from .pattern_packing import op11_pattern_packing
from .sharding import OP3_SQL, op3_sharding
from .simhash import op8_simhash_bk
from .spelling import OP13_SQL, op13_spelling_variants
from .token_cache import op2_token_cache

QUERIES = {
    f.__name__: f
    for f in (
        op1_media_wav,
        op2_token_cache,
        op3_sharding,
        op4_license_rules,
        op5_language_ecoc,
        op6_secret_scan,
        op7_html_subsequence,
        op8_simhash_bk,
        op9_benchmark_suffixes,
        op10_packing,
        op11_pattern_packing,
        op12_hard_negatives,
        op13_spelling_variants,
    )
}
ORACLE_SQL = {"op3_sharding": OP3_SQL, "op6_secret_scan": OP6_SQL, "op4_license_rules": OP4_SQL, "op9_benchmark_suffixes": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_spelling_variants": OP13_SQL}
