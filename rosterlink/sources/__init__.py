"""Readers: roster text, document folders, recorded extraction answers."""
