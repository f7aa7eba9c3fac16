"""Operators for preparing language-model training data.

Nothing outside this package imports it; its queries are registered in
``rulespark.llm.queries``.
"""
