"""Recursive-descent parsers with precedence climbing and panic-mode recovery, one per language.

Each parser first turns the text into its *shape*: comments go, every literal,
number and name becomes one token kind. What is valid depends on the shape
only, and shapes of lines and statements repeat endlessly, so each distinct
shape is parsed once per worker and remembered (a bounded table).
"""

from __future__ import annotations

from .base import Error
from .data import check_json, check_toml, check_yaml
from .python import check_python
from .script import check_script
from .shell import check_shell

#: The parser of each extension.
LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "sh": "bash"}


def check(language: str, text: str) -> list[Error]:
    """All errors of a text, in order of lines; empty if it is valid."""
    text = text.removeprefix("\ufeff")
    if language == "python":
        return check_python(text)
    if language in ("javascript", "typescript"):
        return check_script(text, language == "typescript")
    return {"json": check_json, "yaml": check_yaml, "toml": check_toml, "bash": check_shell}[language](text)
