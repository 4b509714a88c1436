"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from velum.llm.decontaminate import OP10_SQL, op10_decontaminate
from velum.llm.language import op2_language
from velum.llm.linededup import op9_line_dedup
from velum.llm.mixing import OP7_SQL, op7_mixing
from velum.llm.pii import op8_pii
from velum.llm.secrets import op6_secrets
from velum.llm.sharding import op4_sharding
from velum.llm.simhash import op5_simhash
from velum.llm.tokens import op3_token_counts
from velum.llm.topk import OP1_SQL, op1_top_k

QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_language": op2_language,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": OP1_SQL,
    "op7_mixing": OP7_SQL,
    "op10_decontaminate": OP10_SQL,
}
