"""What callers see: payloads, fenced corpus text, and a command line."""
