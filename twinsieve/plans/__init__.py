"""Registered queries. Importing this package fills the registry."""

import importlib

for _name in ("metrics", "sources", "filters", "sampling", "cascade", "cost", "joins", "live"):
    importlib.import_module(f"twinsieve.plans.{_name}")
