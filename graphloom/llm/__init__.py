"""Training-data operators: tokenisation, deduplication, decontamination, language, privacy.

Every module here stands alone on Spark; nothing else in the library imports this subpackage.
"""
