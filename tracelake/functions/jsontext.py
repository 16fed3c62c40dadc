"""JSON inside free text, read with a stack of its own: any text gives a value or nothing, however deep it nests.

A place that fails as the start of an object is remembered with every object that was open there, and one that closed keeps its
end, so the text between two braces is read a bounded number of times whatever the text holds.
"""

from __future__ import annotations

import json
import re
from typing import Any

_SPACE = re.compile(r"[ \t\n\r]*+")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"')
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null|NaN|-?Infinity")
_KEY, _FIRST_KEY, _VALUE, _FIRST_VALUE, _AFTER = range(5)


class Scanner:
    """Ends of the objects and lists of one text."""

    def __init__(self, text: str):
        self.text = text
        self.ends: dict[int, int] = {}

    def end(self, start: int) -> int:
        """Where the object or list that starts at ``start`` ends, -1 where none does."""
        if start not in self.ends:
            self._read(start)
        return self.ends[start]

    def _read(self, start: int) -> None:
        text, ends = self.text, self.ends
        open_ = [start]
        state = _FIRST_KEY if text[start] == "{" else _FIRST_VALUE
        i = start + 1
        while open_:
            i = _SPACE.match(text, i).end()
            c = text[i : i + 1]
            in_object = text[open_[-1]] == "{"
            if c and c == ("}" if in_object else "]") and state in (_FIRST_KEY, _FIRST_VALUE, _AFTER):
                i += 1
                ends[open_.pop()] = i
                state = _AFTER
            elif state == _AFTER and c == ",":
                i += 1
                state = _KEY if in_object else _VALUE
            elif state in (_KEY, _FIRST_KEY) and (key := _STRING.match(text, i)):
                i = _SPACE.match(text, key.end()).end()
                if text[i : i + 1] != ":":
                    break
                i += 1
                state = _VALUE
            elif state in (_VALUE, _FIRST_VALUE) and c and c in "{[":
                known = ends.get(i)
                if known is None:
                    open_.append(i)
                    state = _FIRST_KEY if c == "{" else _FIRST_VALUE
                    i += 1
                elif known < 0:
                    break
                else:
                    i, state = known, _AFTER
            elif state in (_VALUE, _FIRST_VALUE) and (scalar := _STRING.match(text, i) or _SCALAR.match(text, i)):
                i, state = scalar.end(), _AFTER
            else:
                break
        ends.update(dict.fromkeys(open_, -1))


def first_object(text: str) -> str | None:
    """The first part of the text that is a JSON object."""
    scanner, at = Scanner(text), text.find("{")
    while at >= 0:
        end = scanner.end(at)
        if end >= 0:
            return text[at:end]
        at = text.find("{", at + 1)
    return None


def load(doc: str | None) -> Any:
    """The value of a document; None for one that is no JSON."""
    if not doc:
        return None
    try:
        return json.loads(doc)
    except RecursionError:
        return _deep(doc)
    except ValueError:
        return None


def _deep(doc: str) -> Any:
    """A document that nests too deeply for the parser: lists and objects are put together from the inside."""
    start = _SPACE.match(doc).end()
    scanner = Scanner(doc)
    if scanner.end(start) < 0 or doc[scanner.end(start) :].strip(" \t\n\r"):
        return None
    done: dict[int, Any] = {}
    for at in sorted((k for k, e in scanner.ends.items() if e >= 0), reverse=True):
        i, stop, items = at + 1, scanner.ends[at] - 1, []
        while (i := _SPACE.match(doc, i).end()) < stop:
            if doc[i] in ",:":
                i += 1
                continue
            if i in done:
                value, i = done.pop(i), scanner.ends[i]
            else:
                token = _STRING.match(doc, i) or _SCALAR.match(doc, i)
                value, i = json.loads(token.group()), token.end()
            items.append(value)
        done[at] = dict(zip(items[::2], items[1::2], strict=True)) if doc[at] == "{" else items
    return done[start]
