"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it; ``girder.llm.queries`` lists the
registered queries and their oracle SQL.
"""
