"""Queries over the given tables, each with the same answer in plain SQL where SQL can say it."""

MODULES = ("rules", "ingest", "reports", "joins", "texts", "stores", "streams", "audits")


def load_all() -> None:
    """Import every query module, which fills the registry."""
    from importlib import import_module

    for module in MODULES:
        import_module(f"suite.{module}")
