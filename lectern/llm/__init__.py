"""Operators for training-data pipelines at corpus scale.

Nothing outside this subpackage imports it; its queries are listed in
``lectern.llm.queries`` and added by the entry module when importable.
"""
