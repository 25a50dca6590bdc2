"""Registered queries of this package, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from skywatch.llm.chat import ORACLE_OP6, op6_chat
from skywatch.llm.collocations import ORACLE_OP11, op11_collocations
from skywatch.llm.decontaminate import ORACLE_OP1, op1_decontaminate
from skywatch.llm.embeddings import op8_embeddings
from skywatch.llm.html_text import op3_html_text
from skywatch.llm.jaccard import op2_jaccard
from skywatch.llm.language import op5_language
from skywatch.llm.merkle import ORACLE_OP12, op12_merkle
from skywatch.llm.mixing import ORACLE_OP7, op7_mixing
from skywatch.llm.ppm import op10_ppm
from skywatch.llm.sentence_pieces import op13_sentencepiece
from skywatch.llm.suffixes import op9_suffixes
from skywatch.llm.warc import ORACLE_OP4, op4_warc

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_jaccard, op3_html_text, op4_warc, op5_language, op6_chat, op7_mixing, op8_embeddings, op9_suffixes, op10_ppm,
                                 op11_collocations, op12_merkle, op13_sentencepiece)}
ORACLE = {"op1_decontaminate": ORACLE_OP1, "op4_warc": ORACLE_OP4, "op6_chat": ORACLE_OP6, "op7_mixing": ORACLE_OP7,
          "op11_collocations": ORACLE_OP11, "op12_merkle": ORACLE_OP12}
