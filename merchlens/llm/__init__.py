"""Training-data operators: language ID, toxicity, near duplicates, decontamination, tokenising and so on.

Each module holds one operator; ``queries`` registers them. Nothing outside
this subpackage (and ``corpus_pipeline.py``) imports it.
"""
