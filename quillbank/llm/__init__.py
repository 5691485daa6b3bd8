"""Operators for preparing language-model training data at corpus scale.

Nothing else in the package imports this subpackage.
"""
