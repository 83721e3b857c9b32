"""Training-data operators.

Nothing else in the library imports this subpackage; it only depends on PySpark, pyarrow, numpy and,
for the token operators, the ``tokenizers`` library.
"""
