"""Training-data operators: duplicates, licences, leaks, secrets, personal data, toxicity, tokens, media, URLs.

Nothing else in the library imports this subpackage.
"""
