"""Analytics over runs of language-model memory extraction and their judged results, on Spark."""
