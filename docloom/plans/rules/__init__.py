"""The rule language: parser, interpreter, and lowering to Columns."""
