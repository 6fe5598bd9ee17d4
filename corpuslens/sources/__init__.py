"""Where lines come from: table columns, text files, compressed and framed files."""
