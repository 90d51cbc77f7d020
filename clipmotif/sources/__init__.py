"""Readers and writers of the text formats of CLIP analyses, with explicit schemas."""
