"""Normalised tables of a corpus and the finding schema."""

from __future__ import annotations

_BOX = "x0: double, y0: double, x1: double, y1: double"
_GLYPH = f"glyph_id: bigint, ch: string, {_BOX}, size: double, brightness: double"
_COVER = f"cover_id: int, kind: string, top_level: boolean, {_BOX}, brightness: double"

#: One row for each page, with all that lies on it: spatial joins need no exchange. Rows may carry the page's annotations too, as ``annots``, an array of structs of ANNOTS.
LAYOUT = f"doc_id bigint, page int, x0 double, y0 double, x1 double, y1 double, has_metadata boolean, glyphs array<struct<{_GLYPH}>>, covers array<struct<{_COVER}>>"
#: One row for each page, its operators in order.
STREAM_OPS = "doc_id bigint, page int, ops array<struct<seq: bigint, op: string, int_arg: int, shown: binary, depth: int>>"
ANNOTS = "doc_id bigint, page int, ord int, subtype string, rect array<double>, contents string, rc string, overlay_text string"
FILESPECS = "doc_id bigint, source_ord int, ord int, name string, size bigint"
INFO = "doc_id bigint, ord int, key string, value string"
XMP = "doc_id bigint, bytes bigint"
XMP_FIELDS = "doc_id bigint, ord int, name string, value string"
#: One row for each document, its revisions in order, the last one the current.
REVISIONS = "doc_id bigint, revisions array<struct<rev_index: int, text: string>>"
ERRORS = "doc_id bigint, detector string, message string"
DOCS = "doc_id bigint, path string, length bigint, open_status string"

FINDING = ("doc_id", "vector", "severity", "description", "page", "bbox", "evidence", "recommendation", "detector_ord", "emit_ord")
FINDING_SCHEMA = "doc_id bigint, vector string, severity string, description string, page int, bbox array<double>, evidence string, recommendation string, detector_ord int, emit_ord bigint"
#: Detectors in the order in which they report.
VECTORS = ("covered_text", "hidden_text", "revision_history", "embedded_files", "metadata", "redact_annotations")
DESCRIPTIONS = {
    "covered_text": "Text that lies under an opaque rectangle or image.",
    "hidden_text": "Text that is drawn invisibly, in white, too small or off the page.",
    "revision_history": "Text of earlier revisions that the current one no longer shows.",
    "embedded_files": "Files attached to the document.",
    "metadata": "Author, title and other data about the document.",
    "redact_annotations": "Redaction marks that were never applied, and notes.",
}
