"""Query catalogue over the test tables, with its SQL twins."""
