"""Operations of a training-data pipeline: language, quality, toxicity, duplicates, leaks, tokens, shards and search.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
