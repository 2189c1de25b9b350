"""Building blocks that shape plans: skewed joins, lineage cuts, composed jobs."""
