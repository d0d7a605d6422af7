"""prosemetrics: corpus-calibrated text auditing as PySpark plans.

Documents are rows.  Every detector is either a column expression over one
document (no shuffle) or a join against a dictionary table, and the jobs in
``prosemetrics.plans`` put them together into one pass over the corpus.
"""

__version__ = "0.1.0"
