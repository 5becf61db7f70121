"""Training-data operators (extraction, scanning, deduplication, packing, search, tokenisation).

Nothing else in the library imports this subpackage; deleting it leaves the rest working.
"""
