"""Training-data operators: de-duplication, filters, mixing, sharding and formatting of text corpora."""
