"""Structured Streaming form of the mailbox sync."""
