"""Plan fragments that keep results exact when one key holds a large share of the rows."""
