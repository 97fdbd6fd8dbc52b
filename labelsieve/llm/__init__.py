"""Training-data operators: fingerprints, licences, tokens, filters, near copies, chat, pages."""
