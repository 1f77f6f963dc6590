"""Training-data operators: packing, archives, media, scans, dedup, mixing.

Nothing outside this subpackage imports it; deleting the folder leaves the
rest of the library intact.
"""
