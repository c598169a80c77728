"""inkwell: a Spark-native engine for long-form text, its audio timeline and its catalog.

Operators are functions from DataFrames to DataFrames.  ``inkwell.plans`` names
the queries; ``inkwell.llm`` (optional, imported by nothing here) holds the
operators for training data.
"""

__version__ = "0.1.0"
