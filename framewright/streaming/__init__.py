"""Streams.

The engine has no streaming operators of its own. Its row-wise functions, selections and grouped aggregates are plain plan
transformations, so they apply to a streaming DataFrame as they stand; windows over row order, positions and sorts need
a finite table.
"""
