"""Incremental profiles: the mergeable facts (counts, nulls, ranges, sketch registers)
of micro-batches, folded into one state table.  Quantiles and fan-out do not merge and
are left to the batch operators."""
