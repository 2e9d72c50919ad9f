"""PySpark operators for calling and auditing four-haplotype mixtures.

Every public operator takes DataFrames keyed by ``(sample, gene)`` (plus finer
keys where needed) and returns a DataFrame, so a whole cohort is one plan.
"""
