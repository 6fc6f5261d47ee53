"""Literal text that a regular expression needs, and one expression that finds many literals in one pass."""

from __future__ import annotations

from collections.abc import Iterable

LEAST = 3
_SPECIAL = set("\\^$.|?*+()[]{}")


def _alternatives(regex: str) -> list[str] | None:
    """The parts of a regular expression between its outermost bars; None where brackets do not match."""
    parts, depth, start, i, in_class = [], 0, 0, 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            i += regex[i + 1 : i + 2] == "^"
            i += regex[i + 1 : i + 2] == "]"  # a bracket that comes first is a member
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                return None
        elif c == "|" and depth == 0:
            parts.append(regex[start:i])
            start = i + 1
        i += 1
    return None if depth or in_class else [*parts, regex[start:]]


def _longest_run(part: str) -> str:
    """The longest run of plain ASCII characters that every match of a bar-free part holds, in lower case."""
    runs, run, i = [], "", 0

    def close() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(part):
        c, width = part[i], 1
        if c == "\\":
            c, width = part[i + 1 : i + 2], 2
            plain = c and not c.isalnum()
            if c in ("Q", "E"):  # quoted stretches are not taken apart
                return ""
        else:
            plain = c not in _SPECIAL
        if c == "[" and width == 1:
            j = i + 1
            j += part[j : j + 1] == "^"
            j += part[j : j + 1] == "]"
            while part[j : j + 1] not in ("]", ""):
                if part[j] == "[":  # classes inside classes are not taken apart
                    return ""
                j += 2 if part[j] == "\\" else 1
            width = j + 1 - i
        elif c == "(" and width == 1:
            if part[i + 1 : i + 2] == "?" and part[i + 2 : i + 3] != ":":
                return ""  # flags and look-around change what follows
            depth, j, in_class = 1, i + 1, False
            while depth and j < len(part):
                if part[j] == "\\":
                    j += 1
                elif in_class:
                    in_class = part[j] != "]"
                elif part[j] == "[":
                    in_class = True
                else:
                    depth += {"(": 1, ")": -1}.get(part[j], 0)
                j += 1
            width = j - i
        after = part[i + width : i + width + 1]
        if after and after in "?*{":
            close()  # what is repeated may be absent; after a counted one the run starts anew, too
            i += width
            while part[i : i + 1] and part[i] in "?*+{":
                i = part.find("}", i) + 1 if part[i] == "{" else i + 1
                if i == 0:
                    return ""
            continue
        if plain and c.isascii() and c not in "\r\n":
            run += c.lower()
        else:
            close()
        i += width
        if after == "+":
            close()
            while part[i : i + 1] and part[i] in "+?":
                i += 1
    close()
    return max(runs, key=len)


def required_literals(regex: str, flags: str = "") -> list[str] | None:
    """Lower-case ASCII texts one of which occurs, case aside, in everything the expression matches; None when none is certain.

    One text for each outermost alternative, LEAST characters or longer. Only plain characters count; groups, classes,
    optional parts and anything unusual are passed over or give None, so a wrong answer can only be a missing one.
    """
    parts = None if "x" in flags else _alternatives(regex)
    found = [_longest_run(p) for p in parts] if parts else []
    return found if found and all(len(f) >= LEAST for f in found) else None


def _escaped(character: str) -> str:
    return character if character.isalnum() or character in " _-<>@/:;,=&%#!'\"~`" else "\\" + character


def any_of(literals: Iterable[str]) -> str:
    """A regular expression for the longest of some texts at a place: common beginnings are tried once."""
    tree: dict = {}
    for text in literals:
        node = tree
        for character in text:
            node = node.setdefault(character, {})
        node[""] = {}

    def built(node: dict) -> str:
        branches = [_escaped(c) + built(n) for c, n in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in node else body

    return built(tree)


def found_by(literals: Iterable[str]) -> dict[str, list[str]]:
    """For each text, those whose being found at a place says that it is there, too: itself and all it begins."""
    ordered = sorted(set(literals))
    return {text: [other for other in ordered if other.startswith(text)] for text in ordered}
