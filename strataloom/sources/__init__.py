"""Sources: Markdown, layout words, files behind decoders, logs."""
