"""Operators by family; importing a module registers its queries."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("files", "pages", "texts", "splits", "tokens", "windows", "models", "stats", "telemetry", "incidents", "numeric", "sessions", "press", "blocks", "lookup", "rebuild", "generation", "training")


def load() -> None:
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
