"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, decontam, hmm, htmlextract, langid, linededup, minhash, omh, urlfilter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_hmm": hmm.op4_hmm,
    "op5_bpe": bpe.op5_bpe,
    "op6_minhash": minhash.op6_minhash,
    "op7_order_minhash": omh.op7_order_minhash,
    "op8_url_filter": urlfilter.op8_url_filter,
    "op9_language_id": langid.op9_language_id,
    "op10_html": htmlextract.op10_html,
}
ORACLES = {"op1_warc": warc.ORACLE, "op2_decontamination": decontam.ORACLE, "op3_line_dedup": linededup.ORACLE, "op6_minhash": minhash.ORACLE, "op8_url_filter": urlfilter.ORACLE}
