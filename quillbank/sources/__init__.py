"""Readers of workbooks and documents, and writers."""
