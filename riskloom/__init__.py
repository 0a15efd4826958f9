"""Security review of source-code corpora as Spark DataFrame operators."""
