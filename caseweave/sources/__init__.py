"""Files into documents: scanning, routing by name and by content, reading, expanding containers."""
