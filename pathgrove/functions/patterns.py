"""Path patterns as Spark regular expressions: RE2 syntax and shell globs.

Spark's rlike is java.util.regex; these translators keep the meaning of the source syntax and reject at the driver what it rejects.
"""

from __future__ import annotations

import re

#: POSIX classes of RE2 and their ASCII meaning.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z",
    "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}


#: Escapes of RE2 whose meaning in Java is another, outside and inside of character classes.
SPACE, WORD = r"\t\n\f\r ", "0-9A-Za-z_"
OUTSIDE = {
    "s": f"[{SPACE}]", "S": f"[^{SPACE}]", "v": r"\x0B",
    "b": f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))", "B": f"(?:(?<![{WORD}])(?![{WORD}])|(?<=[{WORD}])(?=[{WORD}]))",
}
INSIDE = {"s": SPACE, "S": f"[^{SPACE}]", "v": r"\x0B"}
#: Escapes with a letter that mean the same in Java, in classes and outside of them.
ALIKE, ANCHORS = "aftnrdDwW", "Az"


REPETITION = re.compile(r"(?:[*+?]|\{(\d+)(?:(,)(\d*))?\})\??")


class PatternError(ValueError):
    """A pattern that its syntax doesn't allow."""


def re2_to_java(pattern: str, insensitive: bool = False) -> str:
    """The Java form of an RE2 pattern, for an unanchored match. (?d): only \\n ends a line, as in RE2."""
    out, i, depth, multiline = ["(?d)"] + ["(?iu)"] * insensitive, 0, 0, False
    before = "nothing"  # what a repetition would repeat: nothing, an atom, or a repetition
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if repeated := REPETITION.match(pattern, i):
            if before != "atom":
                raise PatternError("nothing to repeat" if before == "nothing" else "a repetition can't be repeated")
            low, high = int(repeated[1] or 0), int(repeated[3] or 0)
            if max(low, high) > 1000 or repeated[3] and high < low:
                raise PatternError("no such number of repetitions")
            out.append(repeated[0])
            before, i = "repetition", i + len(repeated[0])
            continue
        before = "nothing" if c in "(|" else "atom"
        if two == "\\Q":
            end = pattern.find("\\E", i)
            end = len(pattern) if end < 0 else end
            out.append("".join("\\" + x if not x.isalnum() and x.isascii() else x for x in pattern[i + 2 : end]))
            i = end + 2
        elif c == "\\":
            text, i = _escape(pattern, i, OUTSIDE, ALIKE + ANCHORS)
            out.append(text)
        elif c == "[":
            text, i = _class(pattern, i)
            out.append(text)
        elif two == "(?":
            m = re.match(r"\(\?(?:P?<([A-Za-z_]\w*)>|(-?[imsU]+(?:-[imsU]+)?)?([:)]))", pattern[i:])
            if not m or m[3] == ")" and not m[2]:
                raise PatternError("a group of this kind isn't part of the syntax")
            flags = m[2] or ""
            if "U" in flags:
                raise PatternError("(?U) isn't supported")
            on = flags.split("-")[0]
            if "m" in on:
                multiline = True
            if m[1]:
                out.append(f"(?<{m[1].replace('_', '0')}>" if m[1][0] != "_" else "(")
                depth += 1
            else:
                out.append(f"(?{flags.replace('i', 'iu')}{m[3]}")
                depth += m[3] == ":"
            i += len(m[0])
        elif c == "$":
            out.append("$" if multiline else r"\z")
            i += 1
        elif c == "{":
            out.append("\\{")
            i += 1
        else:
            depth += {"(": 1, ")": -1}.get(c, 0)
            if depth < 0:
                raise PatternError("unexpected )")
            out.append(c)
            i += 1
    if depth:
        raise PatternError("missing )")
    return "".join(out)


def regex_needs(pattern: str, least: int = 1) -> list[frozenset[str]]:
    """What the path of every match of an RE2 pattern contains, whatever its case: of each set at least one of the texts, within one name.
    Texts are ASCII, in lower case, without "/", and have at least ``least`` characters."""
    re2_to_java(pattern)  # an error if it isn't a pattern
    return _needs(pattern, 0, least)[0]


def _needs(pattern: str, i: int, least: int) -> tuple[list[frozenset[str]], int]:
    """The needs of the alternatives from i to the ")" that ends them, and where that is."""
    branches: list[list[frozenset[str]]] = [[]]
    run = ""
    while i <= len(pattern):
        c, inner, literal = pattern[i : i + 1], [], ""
        if c in ("", "|", ")"):
            end = i + 1
        elif c == "(":
            head = re.match(r"\((?:\?(?:P?<\w+>|[imsU-]*([:)])))?", pattern[i:])
            end = i + len(head[0])
            if head[1] != ")":  # else flags for what follows
                inner, end = _needs(pattern, end, least)
                end += 1
        elif c == "[":
            end = _class(pattern, i)[1]
        elif pattern.startswith("\\Q", i):
            end = pattern.find("\\E", i)
            end = len(pattern) if end < 0 else end + 2
        elif c == "\\":
            end = _escape(pattern, i, OUTSIDE, ALIKE + ANCHORS)[1]
            literal = pattern[i + 1] if not pattern[i + 1].isalnum() else ""
        else:
            end = i + 1
            literal = c if c.isascii() and c not in ".^$" else ""
        repeated = REPETITION.match(pattern, end) if c not in ("", "|", ")") else None
        if repeated:
            end = repeated.end()
            if repeated[0][0] in "*?" or repeated[1] and not int(repeated[1]):
                inner, literal = [], ""
        run += literal.lower()
        if repeated or not literal:
            branches[-1] += [frozenset([name]) for name in run.split("/") if len(name) >= least] + inner
            run = ""
        if c == "|":
            branches.append([])
        elif c in ("", ")"):
            break
        i = end
    if len(branches) > 1 and all(branches):  # one need of each branch, the longest
        return [frozenset().union(*(max(b, key=lambda need: (min(map(len, need)), -len(need))) for b in branches))], i
    return branches[0] if len(branches) == 1 else [], i


def _escape(pattern: str, i: int, other: dict[str, str], alike: str) -> tuple[str, int]:
    """The escape that starts at i, and where it ends."""
    c = pattern[i + 1 : i + 2]
    if not c:
        raise PatternError("trailing backslash")
    if c in other:
        return other[c], i + 2
    if c in alike or c.isascii() and not c.isalnum():
        return "\\" + c, i + 2
    if m := re.match(r"\\x([0-9A-Fa-f]{2})|\\x\{([0-9A-Fa-f]{1,6})\}|\\(0[0-7]{0,2}|[1-7][0-7]{1,2})", pattern[i:]):
        code = int(m[1] or m[2] or m[3], 8 if m[3] else 16)
        if code > 0x10FFFF:
            raise PatternError(f"{m[0]} is no character")
        return f"\\x{{{code:X}}}", i + len(m[0])
    if m := re.match(r"\\([pP])(?:([A-Z])|\{(\^?)([A-Za-z_]+)\})", pattern[i:]):
        name = m[2] or m[4]
        negated = (m[1] == "P") != bool(m[3])
        return f"\\{'P' if negated else 'p'}{{{name if len(name) < 3 else 'Is' + name}}}", i + len(m[0])
    raise PatternError(f"\\{c} isn't part of the syntax")


def _class(pattern: str, i: int) -> tuple[str, int]:
    """The class that starts at i, with what Java reads otherwise escaped, and where it ends."""
    out, i = ["["], i + 1
    if pattern[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and not first:
            return "".join(out) + "]", i + 1
        if m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:]):
            if m[2] not in POSIX:
                raise PatternError(f"unknown class {m[0]}")
            out.append(f"[{m[1]}{POSIX[m[2]]}]")
            i += len(m[0])
        elif c == "\\":
            text, i = _escape(pattern, i, INSIDE, ALIKE)
            out.append(text)
        else:
            out.append("\\" + c if c in "[&]^" else c)
            i += 1
        first = False
    raise PatternError("missing ]")


def glob_to_java(pattern: str) -> str:
    """The anchored Java form of a shell pattern: * and ? never match "/", [^...] negates, a backslash escapes."""
    out, i = [r"\A(?s:"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            text, i = _glob_class(pattern, i + 1)
            out.append(text)
        else:
            if c == "\\":
                i += 1
                if i == len(pattern):
                    raise PatternError("trailing backslash")
                c = pattern[i]
            out.append(_literal(c))
            i += 1
    return "".join(out) + r")\z"


def glob_runs(pattern: str, base_only: bool = True) -> list[str]:
    """The literal runs of a shell pattern that the base name of every match contains: those behind the last character that may be a "/"."""
    runs, i = [""], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            _, i = _glob_class(pattern, i + 1)
            runs = [*runs, ""] if base_only else [""]  # a class may match "/", but not in a base name
            continue
        if c == "\\":
            i += 1
            c = pattern[i : i + 1]
            runs[-1] += c
        elif c in "*?":
            runs.append("")
        else:
            runs[-1] += c
        if c == "/":
            runs = [""]
        i += 1
    return [r for r in runs if r]


def _literal(c: str) -> str:
    return "\\" + c if c.isascii() and not c.isalnum() else c


def _glob_class(pattern: str, i: int) -> tuple[str, int]:
    negated = pattern[i : i + 1] == "^"
    i += negated
    ranges: list[str] = []
    seen = False

    def one(i: int) -> tuple[str, int]:
        if i >= len(pattern) or pattern[i] in "-]":
            raise PatternError("bad character class")
        if pattern[i] == "\\":
            i += 1
            if i >= len(pattern):
                raise PatternError("trailing backslash")
        return pattern[i], i + 1

    while True:
        if i < len(pattern) and pattern[i] == "]" and seen:
            nothing = "." if negated else "(?!)"  # only ranges that run backwards
            return f"[{'^' * negated}{''.join(ranges)}]" if ranges else nothing, i + 1
        low, i = one(i)
        high = low
        if pattern[i : i + 1] == "-":
            high, i = one(i + 1)
        if low <= high:
            ranges.append(_literal(low) + "-" + _literal(high))
        seen = True
        if i >= len(pattern):
            raise PatternError("missing ]")
