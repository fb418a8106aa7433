"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from wattline.llm.bpe_lexicon import op4_bpe_lexicon
from wattline.llm.chat_trees import op6_chat_trees
from wattline.llm.gear_chunks import op5_gear_chunks
from wattline.llm.inverted_treaps import ORACLE as RANKED
from wattline.llm.inverted_treaps import op13_inverted_treaps
from wattline.llm.line_rules import op2_line_rules
from wattline.llm.mixing import op8_mixing
from wattline.llm.mpeg_audio import op3_mpeg_audio
from wattline.llm.phrase_names import op11_phrase_names
from wattline.llm.pii_spans import op1_pii_spans
from wattline.llm.shingle_join import op7_shingle_join
from wattline.llm.suffix_dedup import op9_suffix_dedup
from wattline.llm.url_model import op10_url_model
from wattline.llm.vantage_points import ORACLE as MINED
from wattline.llm.vantage_points import op12_vantage_points

QUERIES = {
    "op1_pii_spans": op1_pii_spans,
    "op2_line_rules": op2_line_rules,
    "op3_mpeg_audio": op3_mpeg_audio,
    "op4_bpe_lexicon": op4_bpe_lexicon,
    "op5_gear_chunks": op5_gear_chunks,
    "op6_chat_trees": op6_chat_trees,
    "op7_shingle_join": op7_shingle_join,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_model": op10_url_model,
    "op11_phrase_names": op11_phrase_names,
    "op12_vantage_points": op12_vantage_points,
    "op13_inverted_treaps": op13_inverted_treaps,
}
ORACLES: dict[str, str] = {"op12_vantage_points": MINED, "op13_inverted_treaps": RANKED}
