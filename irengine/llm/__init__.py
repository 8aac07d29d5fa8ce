"""Operators for preparing language-model training text at scale.

Nothing else in :mod:`irengine` imports this subpackage, so it can be removed
without touching the analytics engine.
"""
