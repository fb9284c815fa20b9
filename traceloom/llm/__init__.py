"""Operators for preparing training data: one module each; queries in :mod:`traceloom.llm.queries`."""
