"""Training-data operators: near duplicates, privacy, safety, packing and archives.

Nothing outside this folder imports it; it can be removed as a whole.
"""
