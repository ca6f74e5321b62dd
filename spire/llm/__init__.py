"""Training-data operators: thirteen corpus operators and the queries over them."""
