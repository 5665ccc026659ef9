"""Training-data operators over text and vector tables.

Nothing outside this subpackage imports it.
"""
