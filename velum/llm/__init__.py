"""Training-data operators: search, language, tokens, sharding, duplicates,
secrets, mixing, personal data, lines and benchmark leaks.

Nothing else in the library imports this subpackage.
"""
