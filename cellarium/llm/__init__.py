"""Training-data operators: classifier, deduplication, search, extraction, packing, chat.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
