"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import op2_warc, op4_chat, op8_quality, op12_resample, op13_minhash
from .op1_repair import op1_repair
from .op10_lbl import op10_lbl
from .op11_runs import op11_runs
from .op3_simhash import op3_simhash
from .op5_decontaminate import op5_decontaminate
from .op6_mix import op6_mix
from .op9_extract import op9_extract
from .op7_counts import op7_token_counts

QUERIES = {
    "op1_repair": op1_repair,
    "op2_warc": op2_warc.op2_warc,
    "op3_simhash": op3_simhash,
    "op4_chat": op4_chat.op4_chat,
    "op5_decontaminate": op5_decontaminate,
    "op6_mix": op6_mix,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality.op8_quality,
    "op9_extract": op9_extract,
    "op10_lbl": op10_lbl,
    "op11_runs": op11_runs,
    "op12_resample": op12_resample.op12_resample,
    "op13_minhash": op13_minhash.op13_minhash,
}
ORACLE_SQL: dict[str, str] = {"op2_warc": op2_warc.ORACLE, "op4_chat": op4_chat.ORACLE, "op8_quality": op8_quality.ORACLE, "op12_resample": op12_resample.ORACLE, "op13_minhash": op13_minhash.ORACLE}
