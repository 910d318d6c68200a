"""Flows from documents to reports."""
