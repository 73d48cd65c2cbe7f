"""quire: corpus-wide document analytics as PySpark DataFrame operators."""
