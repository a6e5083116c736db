"""Training-data operators on Spark.

Thirteen operators (tokenising, packing, sharding, deduplication, fixity,
toxicity, media, embeddings, collocations, infilling), each a module of its
own with a general interface; ``queries`` holds the thin registered queries.
Nothing outside this subpackage imports it.
"""
