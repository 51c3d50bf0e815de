"""Operators for preparing language-model training data at scale.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries only where the subpackage is present.
"""
