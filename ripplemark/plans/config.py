"""The settings of the engine, and what of them belongs to a graph's fingerprint."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """Defaults are fixed values of the settings' contract."""

    default_base: str = "origin/main"
    root_namespace: str | None = None
    editor: str | None = "phpstorm"
    dispatch_helpers: tuple[str, ...] = ()
    feature_gate_methods: tuple[str, ...] = ()
    entry_point_roots: tuple[str, ...] = ("Jobs", "Listeners", "Console/Commands", "Filament", "Helpers", "Http/Middleware", "Livewire", "Observers")
    second_hop: bool | str = True
    frontend_roots: tuple[str, ...] = ()
    frontend_generated_paths: tuple[str, ...] = ("actions", "routes", "wayfinder", "ziggy.js")
    frontend_pages_path: str = "resources/js/Pages"
    frontend_test_paths: tuple[str, ...] = ()
    frontend_http_callees: tuple[str, ...] = ()
    cache_enabled: bool = True
    cache_directory: str | None = None
    parity_enabled: bool = True
    parity_mirror_threshold: float = 1.0
    parity_ignore: tuple[str, ...] = ()
    hazards_enabled: bool = True
    hazards_ignore: tuple[str, ...] = ()
    benchmark_cases: tuple[dict, ...] = field(default=(), hash=False)

    #: What changes the graph itself; the rest only changes what is said of it.
    GRAPH = ("root_namespace", "dispatch_helpers", "entry_point_roots", "second_hop", "frontend_roots", "frontend_generated_paths")

    @classmethod
    def of(cls, settings: dict) -> EngineConfig:
        """From nested settings (``frontend.roots`` or ``{"frontend": {"roots": ...}}``); unknown names and wrong types are refused."""
        flat: dict = {}
        names = {"payload_parity": "parity"}
        for key, value in settings.items():
            head = key.split(".")[0]
            if isinstance(value, dict) and head in ("frontend", "cache", "payload_parity", "hazards"):
                flat |= {f"{names.get(head, head)}_{k}": v for k, v in value.items()}
            else:
                flat[key.replace("payload_parity", "parity").replace(".", "_")] = value
        known = cls()
        for key, value in flat.items():
            if not hasattr(known, key) or key == "GRAPH":
                raise ValueError(f"unknown setting: {key}")
            wanted = getattr(known, key)
            if isinstance(wanted, tuple):
                if not isinstance(value, (list, tuple)):
                    raise ValueError(f"{key} must be a list")
                flat[key] = tuple(value)
            elif isinstance(wanted, float) and isinstance(value, (int, float)) and not isinstance(value, bool):
                flat[key] = float(value)
            elif wanted is not None and key != "second_hop" and not isinstance(value, type(wanted)):
                raise ValueError(f"{key} must be a {type(wanted).__name__}")
        return cls(**flat)

    def second_hop_scope(self) -> str:
        """``none``, ``methods`` or ``class``."""
        return {True: "methods", False: "none"}.get(self.second_hop, str(self.second_hop)) if isinstance(self.second_hop, bool) else self.second_hop

    def fingerprint_text(self) -> str:
        """The settings that a graph depends on, as one string, for :func:`ripplemark.plans.cache.fingerprint`."""
        return json.dumps({k: getattr(self, k) for k in self.GRAPH}, sort_keys=True)

    def document(self) -> dict:
        return asdict(self)
