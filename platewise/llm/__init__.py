"""Training-data operators: packing, URL and quality filters, token counts,
language identification, exact top-k search, near duplicates, byte-level BPE,
WARC archives and license scans.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
