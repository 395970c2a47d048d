"""Provenance and retrieval analytics on Spark: intent ledgers, agent sessions, hybrid search and reports as DataFrame operators."""
