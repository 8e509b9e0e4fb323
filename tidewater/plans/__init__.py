"""Registered queries, each with the SQL that states the same result where SQL can."""

from importlib import import_module

MODULES = ("series", "relational", "texts", "links", "flows", "content", "search", "alike", "loads", "measures")


def load() -> None:
    for name in MODULES:
        import_module(f"tidewater.plans.{name}")


load()
