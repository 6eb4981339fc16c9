"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyrogrid.llm.embedding_dedup import OP8_SQL, op8_embedding_dedup
from pyrogrid.llm.fim import OP12_SQL, op12_fill_in_middle
from pyrogrid.llm.langid import op6_language_id
from pyrogrid.llm.line_dedup import OP4_SQL, op4_line_dedup
from pyrogrid.llm.main_text import op13_html_extraction
from pyrogrid.llm.minhash import OP2_SQL, op2_minhash
from pyrogrid.llm.mixing import op7_mixing
from pyrogrid.llm.packing import op3_packing
from pyrogrid.llm.warc import OP5_SQL, op5_warc
from pyrogrid.llm.suffix_dedup import op1_suffix_dedup
from pyrogrid.llm.topk import OP9_SQL, op9_topk
from pyrogrid.llm.token_counts import op10_token_counts
from pyrogrid.llm.vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_minhash, op3_packing, op4_line_dedup, op5_warc, op6_language_id, op7_mixing, op8_embedding_dedup, op9_topk, op10_token_counts, op11_vector_codes, op12_fill_in_middle, op13_html_extraction)
}
ORACLE_SQL = {"op2_minhash": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_warc": OP5_SQL, "op8_embedding_dedup": OP8_SQL, "op9_topk": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
