"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it; its queries are in
``keyloom.llm.queries``.
"""
