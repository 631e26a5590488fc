"""Declared schemas of the tables that operators take and give; library code infers none."""

READS = "sample string, mate int, read_idx bigint, seq string, qual string"
MANIFEST = "sample string, r1 string, r2 string, r1_bytes bigint, r2_bytes bigint, total_bytes bigint"
DISTANCE = "a string, b string, d double"
TRUTH = "name string, parents array<string>, weights array<double>"
EMBEDDING = "sample string, axis int, value double"
SPECTRUM = "axis int, eigenvalue double"
MERGES = "step int, members_left array<string>, members_right array<string>, height double"
NEWICK = "newick string"
LABELS = "sample string, ground_truth string"
