"""Conversation memory retrieval and corpus preparation as Spark DataFrame transforms."""
