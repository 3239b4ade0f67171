"""The thin queries of the training-data operators, and SQL where SQL can express one."""

from sparkloom.llm.bpe import op8_bpe
from sparkloom.llm.cross_tokens import op11_cross_tokens
from sparkloom.llm.line_dedup import op5_line_dedup
from sparkloom.llm.merkle import op13_merkle
from sparkloom.llm.quality import op3_quality
from sparkloom.llm.sharding import op2_sharding
from sparkloom.llm.simhash import op1_simhash
from sparkloom.llm.sql import LINE_DEDUP, MERKLE
from sparkloom.llm.suffix_array import op12_suffix_array
from sparkloom.llm.suffix_tree import op10_suffix_tree
from sparkloom.llm.surrogates import op6_surrogates
from sparkloom.llm.tag_paths import op4_tag_paths
from sparkloom.llm.tiling import op7_tiling
from sparkloom.llm.token_files import op9_token_files

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sharding": op2_sharding,
    "op3_quality": op3_quality,
    "op4_tag_paths": op4_tag_paths,
    "op5_line_dedup": op5_line_dedup,
    "op6_surrogates": op6_surrogates,
    "op7_tiling": op7_tiling,
    "op8_bpe": op8_bpe,
    "op9_token_files": op9_token_files,
    "op10_suffix_tree": op10_suffix_tree,
    "op11_cross_tokens": op11_cross_tokens,
    "op12_suffix_array": op12_suffix_array,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": LINE_DEDUP, "op13_merkle": MERKLE}
