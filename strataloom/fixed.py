"""Words, marks and limits that decide results and are the same wherever they are used."""

from __future__ import annotations

#: Words in a helper's name that name no role.
GENERIC = ("helper", "manager", "processor", "util", "utils", "base", "impl", "wrapper")
#: Marks of a generated file, looked for in its first five lines.
GENERATED = r"@generated|DO NOT EDIT|Code generated"
#: Words of a comment that say nothing, and most words of one that may only repeat a name.
NOISE = (
    "a", "an", "and", "const", "for", "func", "function", "helper", "internal", "local", "method", "of", "or", "private", "return", "returns", "set", "sets",
    "struct", "that", "the", "this", "to", "type", "var", "value",
)
COMMENT_WORDS = 6
