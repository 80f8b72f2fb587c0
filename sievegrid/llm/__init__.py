"""Training-data operators over text, code and conversations. Nothing outside this subpackage imports it."""
