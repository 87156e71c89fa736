"""Operators for training-data pipelines over documents and web pages.

Nothing outside this folder imports it. Each module holds one operator; the
registered queries are in ``queries``.
"""
