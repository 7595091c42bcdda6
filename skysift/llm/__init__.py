"""Operators for preparing training text: duplicates, tokens, quality, languages, leaks, chats, scoring, fingerprints."""
