"""DataFrame operators: segmentation, statistics, resolution, merging, differences, audits and versioned state."""
