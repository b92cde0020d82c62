"""All query modules; importing this fills the registry."""

import importlib

from engram.plans.registry import ORACLE, QUERIES

for _name in ("q_scalar", "q_maps", "q_sequences", "q_pairs", "q_geometry", "q_decode", "q_cohort", "q_stream", "q_speed"):
    importlib.import_module(f"engram.plans.{_name}")

__all__ = ["ORACLE", "QUERIES"]
