"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it. Each module holds one operator; ``queries`` and ``oracles``
hold the thin queries over the test tables and their SQL.
"""
