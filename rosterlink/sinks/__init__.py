"""Exports, submission payloads and the append-only register."""
