"""Braidwork: retrieval and agent-data processing as Spark DataFrame operators."""
