"""Registered queries, one module for each family."""

from importlib import import_module

FAMILIES = ("web", "text", "retrieval", "knowledge", "relational", "answers", "streams", "indexes")


def load() -> None:
    for name in FAMILIES:
        import_module(f"lodestone.plans.{name}")
