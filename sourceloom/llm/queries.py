"""The queries of the subpackage, and their SQL twins where SQL can express them.

None can be: models, token ids, 64-bit window hashes and groups of links have no SQL; ``tests/llm`` compares each with a
brute-force version, an exact round trip or held-out labels.
"""

from __future__ import annotations

from sourceloom.llm.decontamination import op2_decontamination
from sourceloom.llm.html_extraction import op7_html_extraction
from sourceloom.llm.language_id import op1_language_id
from sourceloom.llm.license_scan import op5_license_scan
from sourceloom.llm.ngram_join import op8_ngram_join
from sourceloom.llm.packing import op3_best_fit_packing
from sourceloom.llm.periodic_runs import op12_periodic_runs
from sourceloom.llm.quality_classifier import op10_quality_classifier
from sourceloom.llm.quality_rules import op9_quality_rules
from sourceloom.llm.spelling_variants import op11_spelling_variants
from sourceloom.llm.suffix_dedup import op13_suffix_dedup
from sourceloom.llm.toxicity import op4_toxicity
from sourceloom.llm.url_filter import op6_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_url_filter": op6_url_filter,
    "op7_html_extraction": op7_html_extraction,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLES: dict[str, str] = {}
