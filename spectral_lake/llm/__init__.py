"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` derives the registered result tables.
"""
