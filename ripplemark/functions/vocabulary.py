"""Edge types, node prefixes and the sets of them that steer walks."""

from __future__ import annotations

# Edge-type sets.
STRUCTURAL = ("implements", "declares", "inherits", "uses-trait", "override")
HIERARCHY = ("override", "inherits")
RISK_EXCLUDED = ("model-relationship", "declares", "uses-trait", "override", "model-to-policy", "config-registry", "config-registry-fanout")
ASSOCIATION = ("model-relationship", "model-to-policy", "config-registry-fanout")
REGISTRY = ("config-registry", "config-registry-fanout")
HANDLER = ("route-to-controller", "controller-to-action")

# Node prefixes that mark entry points, and class name parts that mark user-interface surfaces.
ENTRY_PREFIXES = ("route::", "command::", "schedule::")
SURFACE_PARTS = (".Livewire.", ".Filament.", ".Nova.")

MAX_DEPTH = 6
