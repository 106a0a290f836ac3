"""Training-data operators: chat repair, tokenisation, deduplication, decontamination,
scoring, extraction and media packing.  Nothing outside this subpackage imports it."""
