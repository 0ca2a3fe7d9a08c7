"""The queries of this subpackage, by problem."""

from __future__ import annotations

from sacbe.llm import boundaries, grouped_splits, mixing, packing, quality, reading, repetition, scan_repair, split_overlap, subjects
from sacbe.llm.oracles import ORACLES  # noqa: F401

QUERIES = {
    "p1_found": quality.p1_found,
    "p1_statistics": quality.p1_statistics,
    "p2_found": reading.p2_found,
    "p2_levels": reading.p2_levels,
    "p3_found": boundaries.p3_found,
    "p3_sentences": boundaries.p3_sentences,
    "p4_found": split_overlap.p4_found,
    "p4_links": split_overlap.p4_links,
    "p4_report": split_overlap.p4_report,
    "p5_found": scan_repair.p5_found,
    "p5_paragraphs": scan_repair.p5_paragraphs,
    "p6_found": subjects.p6_found,
    "p6_shares": subjects.p6_shares,
    "p7_found": grouped_splits.p7_found,
    "p7_splits": grouped_splits.p7_splits,
    "p7_balance": grouped_splits.p7_balance,
    "p8_packing": packing.p8_packing,
    "p8_waste": packing.p8_waste,
    "p9_mix": mixing.p9_mix,
    "p9_report": mixing.p9_report,
    "p10_found": repetition.p10_found,
    "p10_divergence": repetition.p10_divergence,
}
