"""Queries of this subpackage and the SQL that checks them."""

from docwright.llm.bpe import op2_bpe
from docwright.llm.fingerprint import op7_fingerprints
from docwright.llm.lexical import OP11_SQL, op11_ranked_search
from docwright.llm.linededup import OP6_SQL, op6_line_dedup
from docwright.llm.mixing import OP1_SQL, op1_mixing
from docwright.llm.ngramjoin import op10_ngram_join
from docwright.llm.periodic import op12_periodic_runs
from docwright.llm.quality import op4_quality
from docwright.llm.sharding import op8_sharding
from docwright.llm.tokencount import op13_token_counts
from docwright.llm.toxicity import op9_toxicity
from docwright.llm.urlfilter import OP5_SQL, op5_url_filter
from docwright.llm.webp import op3_media

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_bpe": op2_bpe,
    "op3_media": op3_media,
    "op4_quality": op4_quality,
    "op5_url_filter": op5_url_filter,
    "op6_line_dedup": op6_line_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join,
    "op11_ranked_search": op11_ranked_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_counts": op13_token_counts,
}
SQL = {"op1_mixing": OP1_SQL, "op5_url_filter": OP5_SQL, "op6_line_dedup": OP6_SQL, "op11_ranked_search": OP11_SQL}
