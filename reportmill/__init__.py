"""Spark-first analytics over report catalogues, query logs, documents and vectors."""
