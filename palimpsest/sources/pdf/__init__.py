"""A reader of PDF bytes on the standard library alone, written from the public format specification."""
