"""Operators for preparing text for language models; nothing outside imports this subpackage."""
