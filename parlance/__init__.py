"""Conversation analytics expressed as Spark plans."""
