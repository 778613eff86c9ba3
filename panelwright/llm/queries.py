"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from panelwright.llm import bpe, decontaminate, exact_dedup, filter_audit, hard_negatives, html_extract, language, license_scan, pii, simhash, token_records, url_filter, warc

QUERIES = {
    "op1_token_records": token_records.op1,
    "op2_decontaminate": decontaminate.op2,
    "op3_warc": warc.op3,
    "op4_pii": pii.op4,
    "op5_simhash": simhash.op5,
    "op6_bpe_round_trip": bpe.op6,
    "op7_html_extract": html_extract.op7,
    "op8_language": language.op8,
    "op9_exact_dedup": exact_dedup.op9,
    "op10_url_filter": url_filter.op10,
    "op11_license_scan": license_scan.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_hard_negatives": hard_negatives.op13,
}

ORACLE_SQL = {
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
