"""Regular expressions of the RE2 dialect for the JVM."""

from __future__ import annotations

#: What RE2 does not have: looking around, atomic groups, references back, possessive repetition.
_GROUPS = ("?=", "?!", "?<=", "?<!", "?>")


def re2_to_java(pattern: str) -> str:
    """The same expression for Java: only a line feed ends a line, ``$`` is the end of the text, brackets inside a class are plain.

    ValueError for what RE2 would refuse.  Classes such as ``\\w`` and ``\\b`` are ASCII in both.
    """
    out, at, inside, multiline = ["(?d)"], 0, False, False
    while at < len(pattern):
        c, rest = pattern[at], pattern[at + 1 :]
        if c == "\\":
            if rest[:1].isdigit() and rest[0] != "0":
                raise ValueError("references back are not supported")
            out.append(c + rest[:1])
            at += 2
            continue
        if inside:
            if c == "[" and rest[:1] == ":" and ":]" in rest:
                name = rest[1 : rest.index(":]")]
                out.append(f"\\p{{{'XDigit' if name == 'xdigit' else name.capitalize()}}}" if name != "word" else "\\w")
                at += len(name) + 4
                continue
            if c == "]":
                inside = False
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            inside = True
            out.append(c)
            for first in ("^", "]"):
                if rest[:1] == first:
                    out.append("\\]" if first == "]" else first)
                    at, rest = at + 1, rest[1:]
        elif c == "(" and rest.startswith(_GROUPS):
            raise ValueError("looking around and atomic groups are not supported")
        elif c == "(" and rest.startswith("?P<"):
            out.append("(?<")
            at += 3
        elif c == "(" and rest[:1] == "?":
            flags = rest[1 : min((rest.find(x) for x in "):" if x in rest), default=1)]
            multiline = multiline or "m" in flags.split("-")[0]
            out.append(c)
        elif c == "$" and not multiline:
            out.append("\\z")
        elif c == "+" and at and pattern[at - 1] in "*+?}" and not pattern[: at - 1].endswith("\\"):
            raise ValueError("possessive repetition is not supported")
        else:
            out.append(c)
        at += 1
    return "".join(out)
