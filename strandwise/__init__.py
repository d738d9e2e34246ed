"""Strandwise: sequencing QC and record processing as lazy PySpark DataFrame operators."""
