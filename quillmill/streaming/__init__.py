"""Resumable and continuous runs."""
