"""The jobs a user runs, composed of the operators."""

from .changes import Kept, corrected, keep, kept_summary
from .reconcile import extract, reconcile, reconcile_attempts
from .submit import read_once, submit, submit_once
from .view import ordered, view

__all__ = ["Kept", "corrected", "extract", "keep", "kept_summary", "ordered", "read_once", "reconcile", "reconcile_attempts", "submit", "submit_once", "view"]
