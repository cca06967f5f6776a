"""Feature layers: names, reference columns and the columns that describe the proposed state."""

from __future__ import annotations

BASELINE, POST = "baseline", "post-intervention"

# Layer table names in the source files.
LAYER_TABLES = {
    "redline": "Red Line Boundary",
    "habitats": "Habitats",
    "hedgerows": "Hedgerows",
    "rivers": "Rivers",
    "trees": "Urban Trees",
}

# Proposed-state columns per layer; retention is one of them everywhere.
PROPOSED_COLUMNS = {
    "habitats": ["prop_broad", "prop_type", "prop_condition", "prop_strategic_sig", "prop_distinctiveness"],
    "hedgerows": ["prop_type", "prop_condition", "prop_strategic_sig", "prop_distinctiveness"],
    "rivers": [
        "prop_type", "prop_condition", "prop_strategic_sig", "prop_distinctiveness",
        "prop_encroachment", "prop_riparian",
    ],
    "trees": ["prop_size", "prop_condition", "prop_strategic_sig", "prop_tree_type", "prop_rural_urban"],
}
RETENTION = "retention"
REF_COLUMNS = {"habitats": "parcel_ref", "hedgerows": "parcel_ref", "rivers": "parcel_ref", "trees": "tree_ref"}

# The layers every file must have and the coordinate system all must be in.
REQUIRED_LAYERS = ("Red Line Boundary", "Habitats")
NATIONAL_GRID_SRID = 27700


def cleared_columns(layer: str) -> list[str]:
    return [*PROPOSED_COLUMNS[layer], RETENTION]
