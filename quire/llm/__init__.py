"""Operators for training-data pipelines over corpora far larger than memory.

Nothing else in ``quire`` imports this subpackage; its queries and their SQL live in
``quire.llm.queries`` and are added to the entry point only while it can be imported.
"""
