"""Registered queries of the engine."""

from importlib import import_module

MODULES = ("url_queries", "site_queries", "run_queries", "content_queries", "event_queries", "stream_queries", "report_queries", "request_queries")


def load_all():
    """Import every plan module, so that the registry is full."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
