"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator; each operator module has its own general interface.
"""
