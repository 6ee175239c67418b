"""Training-data operators: language ID, tokenising, fingerprints, chat formatting, near and exact
duplicates, privacy, secrets, packing and web archives. Nothing outside this subpackage imports it."""
