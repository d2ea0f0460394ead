"""Readers of files, text, change feeds and index shards; writers of indexes and exports."""
