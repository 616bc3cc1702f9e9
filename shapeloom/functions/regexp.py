r"""The layouts' regular expressions, translated to the JVM's dialect.

The dialect has ``( ) | [ ] [^ ] \ ? * +``. All other characters, ``.`` and braces among
them, stand for themselves, and a repetition applies to the whole alternative so far, not
to the last atom: ``ab*`` is ``(ab)*``.
"""

from __future__ import annotations

import re

#: Escapes that stand for a control character; any other escaped character is itself.
CONTROLS = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b"}


class _Reader:
    def __init__(self, source: str):
        self.source, self.at = source, 0

    def peek(self) -> str:
        return self.source[self.at : self.at + 1]

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"unexpected end of regular expression {self.source!r}")
        self.at += 1
        return c

    def char(self) -> str:
        c = self.take()
        return CONTROLS.get(d := self.take(), d) if c == "\\" else c


def _class(r: _Reader) -> tuple:
    negated = r.peek() == "^"
    if negated:
        r.take()
    parts = []
    while r.peek() != "]":
        a = r.char()
        b = a
        if r.peek() == "-" and r.source[r.at + 1 : r.at + 2] not in ("]", ""):
            r.take()
            b = r.char()
        if b < a:
            raise ValueError(f"empty range in {r.source!r}")
        parts.append((a, b))
    r.take()
    return ("class", negated, tuple(parts))


def _alternatives(r: _Reader, inside: bool) -> tuple:
    done, now = [], []
    while True:
        c = r.peek()
        if not c or (c == ")" and inside):
            if inside and not c:
                raise ValueError(f"unclosed group in {r.source!r}")
            break
        r.take()
        if c == "(":
            now.append(_alternatives(r, True))
            r.take()
        elif c == "[":
            now.append(_class(r))
        elif c == "|":
            done.append(("seq", tuple(now)))
            now = []
        elif c in "?*+":
            now = [("repeat", c, ("seq", tuple(now)))]
        elif c == "\\":
            r.at -= 1
            now.append(("char", r.char()))
        else:
            now.append(("char", c))
    done.append(("seq", tuple(now)))
    return done[0] if len(done) == 1 else ("or", tuple(done))


def parse(source: str) -> tuple:
    """The syntax tree."""
    r = _Reader(source)
    tree = _alternatives(r, False)
    if r.peek():
        raise ValueError(f"unexpected {r.peek()!r} in {source!r}")
    return tree


def singleton(tree: tuple) -> str | None:
    """The one string that matches, if there is just one."""
    match tree:
        case ("char", c):
            return c
        case ("class", False, ((a, b),)) if a == b:
            return a
        case ("seq", parts):
            texts = [singleton(p) for p in parts]
            return None if None in texts else "".join(texts)
        case ("or", options):
            texts = {singleton(o) for o in options}
            return texts.pop() if len(texts) == 1 else None
        case ("repeat", _, inner):
            return "" if singleton(inner) == "" else None
    return None


def _quote(c: str) -> str:
    return c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}"


def _java(tree: tuple) -> str:
    match tree:
        case ("char", c):
            return _quote(c)
        case ("class", negated, parts):
            inner = "".join(_quote(a) if a == b else f"{_quote(a)}-{_quote(b)}" for a, b in parts)
            return (f"[^{inner}]" if negated else f"[{inner}]") if parts else ("(?s:.)" if negated else "(?!)")
        case ("seq", parts):
            return "".join(_java(p) if p[0] != "or" else f"(?:{_java(p)})" for p in parts)
        case ("or", options):
            return "|".join(_java(o) for o in options)
        case ("repeat", how, inner):
            return f"(?:{_java(inner)}){how}"
    raise AssertionError(tree)


def to_java(source: str) -> str:
    """A pattern for ``rlike`` that matches whole strings."""
    return f"^(?:{_java(parse(source))})\\z"


def to_python(source: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), _java(parse(source))))


def _ranges(parts: tuple) -> list[tuple[int, int]]:
    """A class's characters as ordered ranges that don't touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((ord(a), ord(b)) for a, b in parts):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


LAST = 0x10FFFF


def _rest(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The characters that ordered ranges leave out."""
    out, at = [], 0
    for a, b in ranges:
        if a > at:
            out.append((at, a - 1))
        at = b + 1
    return [*out, (at, LAST)] if at <= LAST else out


def simplified(tree: tuple) -> tuple:
    """The same language with nested sequences joined, alternatives of alternatives flat,
    classes as ordered ranges and classes of one character as that character."""
    match tree:
        case ("class", negated, parts):
            ranges = _ranges(parts)
            if not negated and len(ranges) == 1 and ranges[0][0] == ranges[0][1]:
                return ("char", chr(ranges[0][0]))
            return ("class", negated, tuple((chr(a), chr(b)) for a, b in ranges))
        case ("seq", parts):
            flat = [x for p in map(simplified, parts) for x in (p[1] if p[0] == "seq" else (p,))]
            return flat[0] if len(flat) == 1 else ("seq", tuple(flat))
        case ("or", options):
            flat = list(dict.fromkeys(x for o in map(simplified, options) for x in (o[1] if o[0] == "or" else (o,))))
            return flat[0] if len(flat) == 1 else ("or", tuple(flat))
        case ("repeat", how, inner):
            return ("repeat", how, simplified(inner))
    return tree


def show(tree: tuple) -> str:
    """The expression in the layouts' own dialect."""
    names = {c: n for n, c in CONTROLS.items()}

    def char(c: str, more: str = "") -> str:
        return "\\" + names[c] if c in names else "\\" + c if c in "()|[]\\?*+" + more else c

    def span(a: str, b: str) -> str:
        between = "-" if ord(b) > ord(a) + 1 else ""
        return char(a, "-^") if a == b else f"{char(a, '-^')}{between}{char(b, '-^')}"

    def of(t: tuple, alone: bool) -> str:
        match t:
            case ("char", c):
                return char(c)
            case ("class", negated, parts):
                ranges = _ranges(parts)
                if 2 * sum(b - a + 1 for a, b in ranges) > LAST + 1:  # the rest is shorter to say
                    negated, ranges = not negated, _rest(ranges)
                return f"[{'^' if negated else ''}{''.join(span(chr(a), chr(b)) for a, b in ranges)}]"
            case ("seq", parts):
                shown = "".join(of(p, False) for p in parts)
            case ("or", options):
                shown = "|".join(of(o, True) for o in options)
            case ("repeat", how, inner):
                return of(inner, False) + how if alone else f"({of(inner, False)}{how})"
        return shown if alone else f"({shown})"

    return of(simplified(tree), True)
