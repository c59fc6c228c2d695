"""The queries of this package, with their SQL where there is any."""

from __future__ import annotations

from arborq.llm.annulus import OP11_SQL, op11_annulus_clusters
from arborq.llm.chat import OP1_SQL, op1_chat_format
from arborq.llm.codec import op4_token_ids
from arborq.llm.common import release
from arborq.llm.exact import OP6_SQL, op6_exact_dedup
from arborq.llm.lang import op7_language_id
from arborq.llm.lines import OP10_SQL, op10_line_dedup
from arborq.llm.lm import op2_lm_scoring
from arborq.llm.media import op3_media_columns
from arborq.llm.mixing import op8_source_mixing
from arborq.llm.near import op5_near_dedup
from arborq.llm.packing import op9_packing
from arborq.llm.repair import op12_conversation_repair
from arborq.llm.warc import OP13_SQL, op13_warc

__all__ = ["QUERIES", "SQL", "release"]
QUERIES = {"op1_chat_format": op1_chat_format, "op2_lm_scoring": op2_lm_scoring, "op3_media_columns": op3_media_columns, "op4_token_ids": op4_token_ids, "op5_near_dedup": op5_near_dedup, "op6_exact_dedup": op6_exact_dedup, "op7_language_id": op7_language_id, "op8_source_mixing": op8_source_mixing, "op9_packing": op9_packing, "op10_line_dedup": op10_line_dedup, "op11_annulus_clusters": op11_annulus_clusters, "op12_conversation_repair": op12_conversation_repair, "op13_warc": op13_warc}
SQL = {"op1_chat_format": OP1_SQL, "op6_exact_dedup": OP6_SQL, "op10_line_dedup": OP10_SQL, "op11_annulus_clusters": OP11_SQL, "op13_warc": OP13_SQL}
