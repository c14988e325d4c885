"""Operators for large-scale training-data pipelines; nothing else in quern imports them."""
