"""Operators that clean, judge and pack text for training corpora.

Nothing else in the library imports this package. Every operator takes and returns DataFrames;
``riskpanel.llm.queries`` registers one query per operator over the shared tables.
"""
