"""Readers that turn landed feed payloads into raw postings."""
