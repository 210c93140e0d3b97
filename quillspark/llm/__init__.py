"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it stands on Spark and
on the Python packages named in each module only.
"""
