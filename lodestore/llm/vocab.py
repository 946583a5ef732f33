"""Where the public tokenizers' vocabulary files lie. The path is a parameter; files are never copied here."""

from __future__ import annotations


def vocabulary_path(name: str, path: str | None = None) -> str:
    """``path``, or where the installed vocabulary package keeps ``name``; resolved on the worker that reads it."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)
