"""Training-data operators: dedup, quality, secrets, licences, mixing, packing, chat format, language-model scores."""
