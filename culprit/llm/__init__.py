"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator is a
function ``(DataFrame, ...) -> DataFrame``; the thin contract queries live in
:mod:`culprit.llm.queries`.
"""
