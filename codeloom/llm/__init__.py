"""Training-data operators: ten distributed operators over documents, pages and conversations.

Nothing outside this folder imports it.  ``codeloom.llm.queries`` holds the thin
``opN_*`` queries and their SQL; ``corpus_pipeline.py`` chains five of them.
"""
