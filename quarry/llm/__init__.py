"""Operators for training-data pipelines (toxicity, dedup, language model, secrets,
personal data, quality, mixing, embeddings, decontamination, SimHash).

Nothing outside this subpackage (but the pipeline module at the repository top)
imports it; ``queries`` holds the registered queries and their SQL.
"""

import sys

from pyspark import cloudpickle

# the functions that run in tasks travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
