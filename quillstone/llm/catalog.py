"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from quillstone.llm import checked
from quillstone.llm.bpe import op10_bpe
from quillstone.llm.codes import ORACLE_OP12, op12_codes
from quillstone.llm.fingerprints import op2_fingerprints
from quillstone.llm.langid import op3_langid
from quillstone.llm.lines import ORACLE_OP11, op11_lines
from quillstone.llm.lm import op9_lm
from quillstone.llm.mixing import ORACLE_OP4, op4_mixing
from quillstone.llm.neardup import op5_neardup
from quillstone.llm.quality import op8_quality
from quillstone.llm.substrings import op7_substrings
from quillstone.llm.urls import op6_urls
from quillstone.llm.warc import ORACLE_OP1, op1_warc
from quillstone.llm.whitening import op13_whitening

QUERIES = {
    "op1_warc": op1_warc,
    "op2_fingerprints": op2_fingerprints,
    "op3_langid": op3_langid,
    "op4_mixing": op4_mixing,
    "op5_neardup": op5_neardup,
    "op6_urls": op6_urls,
    "op7_substrings": op7_substrings,
    "op8_quality": op8_quality,
    "op9_lm": op9_lm,
    "op10_bpe": op10_bpe,
    "op11_lines": op11_lines,
    "op12_codes": op12_codes,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
    **checked.QUERIES,
}
ORACLES = {"op1_warc": ORACLE_OP1, "op4_mixing": ORACLE_OP4, "op5_neardup": checked.ORACLE_OP5, "op7_substrings": checked.ORACLE_OP7, "op11_lines": ORACLE_OP11, "op12_codes": ORACLE_OP12, **checked.ORACLES}
