"""Training-data operators: quality, tokenisation, duplicate removal, language, toxicity, packing.

Nothing outside this subpackage imports it; ``queries`` and ``oracle`` list what
``__spark_entry__`` registers.
"""
