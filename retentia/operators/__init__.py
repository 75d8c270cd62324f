"""Row-level operators: cleaning, generation, sampling, splitting, joins."""
