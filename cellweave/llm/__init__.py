"""Training-data operators.

Ten operators over the text and web tables, each in a module of its own, and
``queries`` with the registered ``opN_*`` queries.  Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
