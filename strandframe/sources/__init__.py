"""Readers and writers of the text formats of sequence work."""
