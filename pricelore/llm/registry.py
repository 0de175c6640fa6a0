"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from pricelore.llm.collocations import OP13_SQL, op13_phrase_tries
from pricelore.llm.decontaminate import OP3_SQL, op3_containment_decontamination
from pricelore.llm.flac import op9_flac_media
from pricelore.llm.licence_scan import op2_licence_lines
from pricelore.llm.line_dedup import OP12_SQL, op12_hashed_lines
from pricelore.llm.middle_fill import OP11_SQL, op11_framed_middle
from pricelore.llm.near_duplicates import op1_lsh_forest_join
from pricelore.llm.personal_data import op5_anchor_personal_data
from pricelore.llm.piece_sampling import op7_gumbel_pieces
from pricelore.llm.secret_scan import op4_markov_secrets
from pricelore.llm.token_store import op8_simple8b_tokens
from pricelore.llm.toxicity import op6_nnpu_toxicity
from pricelore.llm.url_filter import op10_association_urls

QUERIES = {
    f.__name__: f
    for f in (
        op1_lsh_forest_join,
        op2_licence_lines,
        op3_containment_decontamination,
        op4_markov_secrets,
        op5_anchor_personal_data,
        op6_nnpu_toxicity,
        op7_gumbel_pieces,
        op8_simple8b_tokens,
        op9_flac_media,
        op10_association_urls,
        op11_framed_middle,
        op12_hashed_lines,
        op13_phrase_tries,
    )
}
ORACLE_SQL = {"op3_containment_decontamination": OP3_SQL, "op11_framed_middle": OP11_SQL, "op12_hashed_lines": OP12_SQL, "op13_phrase_tries": OP13_SQL}
