"""Fixed values of the comparison: thresholds, limits and wire names."""

# Thresholds that decide results.
POSITION_TOLERANCE = 1.5
COLUMN_GAP = 24.0
BLOCK_SIMILARITY = 0.55
BLOCK_SIMILARITY_FAR = 0.78
FLOW_TOKEN_SIMILARITY = 0.75
FLOW_LINE_SIMILARITY = 0.65
PAGE_MATCH = 0.82
PAGE_GAP = -0.35
PAGE_TIE = 1.1920929e-07
LOW_CONFIDENCE = 0.75
MAX_CHANGES = 4096
MAX_RUN_PAIRS = 4_000_000
MAX_MATRIX_CELLS = 4_000_000
MAX_ANCHOR_CELLS = 1_000_000
MAX_SIMILARITY_CELLS = 4096
MAX_CONTEXT_LINES = 100
ROLE_BAND, ROLE_LEAST_BAND, ROLE_MOST_BAND, ROLE_LENGTH = 0.15, 24.0, 0.3, 240
FINGERPRINT_SIDE = 32

# Wire names.
PAGE_STATUSES = ("equal", "modified", "inserted", "deleted", "moved")
CHANGE_KINDS = ("added", "removed", "modified", "moved", "reflowed")
STRUCTURES = ("paragraph", "list-item", "table-row")
ROLES = ("body", "header", "footer")
FIGURE_STATUSES = ("added", "removed", "modified", "moved", "swapped")
WARNINGS = (
    "low-alignment-confidence", "content-reordered", "text-unavailable", "text-partial", "text-suspect", "text-diff-truncated",
    "text-changes-truncated", "page-geometry-changed", "semantic-visual-disagreement", "visual-not-computed",
)
