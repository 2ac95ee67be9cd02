"""Content-policy and list-curation analytics as Spark DataFrame operators."""
