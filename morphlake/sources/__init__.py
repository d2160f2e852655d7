"""Readers: text, files, prediction logs, lexicons, model bundles."""
