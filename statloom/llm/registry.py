"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import embedding_join, exact_dedup, jaccard_join, language_id, licenses, mixing, packing, pii, quality, substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        language_id.op1_language_id,
        jaccard_join.op2_jaccard_join,
        licenses.op3_license_scan,
        exact_dedup.op4_exact_dedup,
        embedding_join.op5_embedding_join,
        pii.op6_pii,
        packing.op7_packing,
        substring_dedup.op8_substring_dedup,
        quality.op9_quality,
        mixing.op10_mixing,
    )
}
ORACLE = {**exact_dedup.SQL, **mixing.SQL, **jaccard_join.SQL, **substring_dedup.SQL, **embedding_join.SQL}
