"""Training-data operators: quality, filters, packing, archives, decontamination, duplicates, privacy."""
