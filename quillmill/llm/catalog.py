"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from quillmill.llm import chat, decontaminate, htmltext, licenses, linededup, mixing, ngramjoin, quality, urlfilter, warc

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_line_dedup": linededup.query,
    "op3_decontamination": decontaminate.query,
    "op4_html_extraction": htmltext.query,
    "op5_warc": warc.query,
    "op6_mixing": mixing.query,
    "op7_ngram_join": ngramjoin.query,
    "op8_quality_rules": quality.query,
    "op9_chat_formatting": chat.query,
    "op10_url_filters": urlfilter.query,
}
ORACLE_SQL = {
    "op2_line_dedup": linededup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op7_ngram_join": ngramjoin.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
    "op10_url_filters": urlfilter.ORACLE,
}
