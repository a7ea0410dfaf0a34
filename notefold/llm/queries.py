"""Registered queries of the text operators, and their SQL."""

from __future__ import annotations

from notefold.llm import bpe, garbled, lookalikes, markup, near_copies, packing, personal, scan_noise, template_residue
from notefold.sources.tables import table

QUERIES = {
    "p1_found": lambda s, d: scan_noise.noise_found(table(s, d, "ocr_results")),
    "p1_paragraphs": lambda s, d: scan_noise.paragraphs(table(s, d, "ocr_results")),
    "p2_found": lambda s, d: lookalikes.lookalikes_found(lookalikes.texts_of(table(s, d, "notes"), table(s, d, "ocr_results"))),
    "p2_normalized": lambda s, d: lookalikes.normalized(lookalikes.texts_of(table(s, d, "notes"), table(s, d, "ocr_results"))).select("field", "record_key", "normal"),
    "p3_found": lambda s, d: template_residue.residue_found(table(s, d, "notes")),
    "p3_real_content": lambda s, d: template_residue.real_content(table(s, d, "notes")).select("note_id", "title", "body_text").distinct(),
    "p5_found": lambda s, d: near_copies.copies_found(lookalikes.texts_of(table(s, d, "notes"), table(s, d, "ocr_results"))),
    "p5_groups": lambda s, d: near_copies.copy_groups(lookalikes.texts_of(table(s, d, "notes"), table(s, d, "ocr_results"))),
    "p6_found": lambda s, d: personal.personal_found(lookalikes.texts_of(table(s, d, "notes"), table(s, d, "ocr_results"))),
    "p6_redacted": lambda s, d: personal.redacted(lookalikes.texts_of(table(s, d, "notes"), table(s, d, "ocr_results"))),
    "p7_found": lambda s, d: markup.markup_found(markup.pages_of(table(s, d, "notes"), table(s, d, "ocr_results"))),
    "p7_clean": lambda s, d: markup.clean_texts(markup.pages_of(table(s, d, "notes"), table(s, d, "ocr_results"))),
    "p7_style_tree": lambda s, d: markup.style_tree(markup.pages_of(table(s, d, "notes"), table(s, d, "ocr_results"))),
    "p10_found": lambda s, d: garbled.garbled_found(table(s, d, "documents")),
    "p10_restored": lambda s, d: garbled.restored(table(s, d, "documents")),
    "p8_ids": lambda s, d: bpe.encode_corpus(table(s, d, "documents")),
    "p9_packed": lambda s, d: packing.pack_documents(table(s, d, "documents"), table(s, d, "pack_capacities")),
    "p9_fill": lambda s, d: packing.fill(packing.pack_documents(table(s, d, "documents"), table(s, d, "pack_capacities"))),
}
SQL: dict[str, str] = {}
