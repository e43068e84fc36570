"""Settings that change results."""

from __future__ import annotations

# The classes and their ids.
LABELS = {
    "background": 0,
    "no_Tissu": 1,
    "no_Tumor": 2,
    "Tumor": 3,
    "ACINAIRE": 4,
    "LÉPIDIQUE": 5,
    "MICROPAPILLAIRE": 6,
    "COMPLEX_GLANDULAR": 7,
    "STROMA_FIBREUX": 8,
    "STROMA_INFLAM": 9,
    "NÉCROSE": 10,
    "SOLIDE": 11,
    "CRIBRIFORME": 12,
    "PAPILLAIRE": 13,
}
# Coarse classes; any other class beats them, and regions and walks leave them out.
EXCLUDED = ("background", "no_Tissu", "no_Tumor", "Tumor")
BACKGROUND = "background"

# Sizes, limits and seed.
PATCH = 224
TARGET_MPP = 0.5
DEFAULT_MPP = 0.25
MIN_REGION = 30
WALK_MIN, WALK_MAX = 30, 40
MAX_REDUNDANCY = 50
MAX_IMBALANCE = 10
SEED = 42

# Offsets (dc, dr) of the six neighbours, clockwise from the top, for even and odd columns.
NEIGHBOURS = {
    0: ((0, -1), (1, -1), (1, 0), (0, 1), (-1, 0), (-1, -1)),
    1: ((0, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)),
}
