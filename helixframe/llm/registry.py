"""The text operators' queries and SQL."""

from __future__ import annotations

from . import fingerprints, html_text, licenses, line_quality, mixing, neardup, packing, pii, quality_rules, url_filters

QUERIES = {
    "op1_license_scans": licenses.op1_license_scans,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_line_quality": line_quality.op3_line_quality,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_packing": packing.op5_packing,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_mixing": mixing.op7_mixing,
    "op8_pii": pii.op8_pii,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLES: dict[str, str] = {
    "op1_license_scans": licenses.ORACLE,
    "op4_near_duplicates": neardup.ORACLE,
    "op8_pii": pii.ORACLE,
    "op9_url_filters": url_filters.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
}
