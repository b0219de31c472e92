"""The queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from .alignment import op12_alignment
from .bestfit import op11_best_fit
from .embedding_dedup import op2_embedding_dedup
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .minhash import op3_minhash
from .html_extract import op6_html_extract
from .mixing import op7_mixing
from .packing import op4_packing
from .quality import op8_quality
from .resampling import op13_resampling
from .secrets import op9_secrets
from .toxicity import op10_toxicity
from .url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_minhash": op3_minhash,
    "op4_packing": op4_packing,
    "op5_url_filter": op5_url_filter,
    "op6_html_extract": op6_html_extract,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
    "op11_best_fit": op11_best_fit,
    "op12_alignment": op12_alignment,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op5_url_filter": OP5_SQL,
}
