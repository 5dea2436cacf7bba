"""Where tables come from: files, PDF bytes, and a layout made of plain text."""
