"""Training-data operators: token counts, decontamination, BPE, deduplication, search, WARC, chat, language, licences.

Nothing else in the library imports this subpackage.
"""
