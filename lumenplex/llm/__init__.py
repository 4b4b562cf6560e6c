"""Training-data operators: quality, chat, tokens, licences, duplicates, search and packing."""
