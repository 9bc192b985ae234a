"""Schemas of the engine's relations. Offsets name their unit: ``abs_byte`` counts UTF-8 bytes, columns count code points."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string"
LINES = "doc_id long, line_idx int, line string, abs_byte long, n_bytes int, n_chars int, is_blank boolean"
HIGHLIGHTS = "doc_hash string, start long, end long, created_at long"
MARKS = "doc_hash string, mark string, line long, col long"
#: The document hash is an unsigned 64-bit number in the log, beyond a long.
PROGRESS_LOG = (
    "UpdateProgress struct<timestamp: timestamp, document_hash: decimal(20,0), offset: bigint, total_lines: bigint, "
    "percentage: double, viewport_offset: bigint, cursor_y: bigint>"
)
BOOKMARK_FILE = "marks map<string, array<bigint>>"
HIGHLIGHT_FILE = "document_hash string, highlights array<struct<start: bigint, end: bigint, created_at: bigint>>, version int"
