"""Readers of paged, Markdown and JSON inputs under explicit contracts."""
