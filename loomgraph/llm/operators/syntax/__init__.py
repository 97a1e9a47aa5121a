"""Recursive-descent parsers of six languages; ``check`` picks one by the extension of the path."""

from __future__ import annotations

import sys

#: The language a path stands for by its extension.
LANGUAGES = {".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".php": "php"}
#: Nested calls a worker allows. They lie on the heap, not on the stack of the process, and are as many as the text nests.
DEPTH = 1_000_000


def language(path: str | None) -> str | None:
    """The language of a path, or None for an unknown extension."""
    if not path or "." not in path:
        return None
    return LANGUAGES.get(path[path.rfind(".") :].lower())


def check(code: str, path: str) -> list[tuple[int, str]] | None:
    """All errors of a text as (line, message), none for a valid one; None where the path's language is not known."""
    lang = language(path)
    if lang is None:
        return None
    code = code.removeprefix("﻿")
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    if lang == "python":
        from .python import Python

        return Python(code).run()
    if lang == "java":
        from .java import Java

        return Java(code).run()
    if lang == "kotlin":
        from .kotlin import Kotlin

        return Kotlin(code, path).run()
    if lang == "php":
        from .php import Php

        return Php(code, path).run()
    from .javascript import JavaScript

    return JavaScript(code, path).run()
