"""Where strings and comments are, and which bracket closes which.

``lex`` is an automaton over a stretch of source text: it starts in a given state, blanks strings
and comments, and tells the state it ends in, so a file may be read in pieces. A state names
what is open: ``""`` code, ``/*2`` a block comment two deep, the quote of an open string, ```` ` ```` a
template text, ``{3`` the code inside a template with three braces open; the outermost stands first.
JavaScript adds ``.`` after a value, where a slash divides and begins no pattern.

``statements`` cuts masked code into statements by the brackets and separators around them, each
with the text of its own bracket level only, and finds the end of its block.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

_INNER = {q: re.compile(r"(?:[^\\%s]|\\[\s\S])*" % q) for q in "\"'`"}
_ONE_LINE = {q: re.compile(r"(?:[^\\\n%s]|\\[\s\S])*" % q) for q in "\"'"}
_TRIPLE = {q: re.compile(r"(?:[^\\%s]|\\[\s\S]|%s(?!%s%s))*" % (q, q, q, q)) for q in "\"'"}
_TEMPLATE = re.compile(r"(?:[^\\`$]|\\[\s\S]|\$(?!\{))*")
_NESTED = re.compile(r"/\*|\*/")
# a slash after one of these begins a pattern, not a division
_BEFORE_PATTERN = re.compile(r"(?:^|[^\w$])(?:return|typeof|case|in|of|delete|void|throw|new|else|do|instanceof|yield|await)$")
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")

TOKEN = {
    "python": re.compile(r"#[^\n]*|\b[rRbBuUfFtT]{0,2}(?:\"\"\"|'''|\"|')|\"\"\"|'''|\"|'"),
    "java": re.compile(r"//[^\n]*|/\*|\"\"\"|\"|'"),
    "javascript": re.compile(r"//[^\n]*|/\*|\"|'|`|/"),
    "rust": re.compile(r"//[^\n]*|/\*|\b(?:b|c)?r#*\"|\b[bc]?\"|\"|\bb?'(?:[^'\\\n]|\\[^\n][^'\n]{0,10})'|'(?:[^'\\\n]|\\[^\n][^'\n]{0,10})'|'"),
}
_IN_TEMPLATE = re.compile(TOKEN["javascript"].pattern + r"|[{}]")
#: states that a piece of a file may well begin in, besides code
USUAL = {"python": ['"""', "'''"], "java": ["/*1", '"""'], "javascript": [".", "/*1", ". /*1", "`"], "rust": ["/*1", '"']}


def _blank(text: str) -> str:
    return "\n".join([" " * len(line) for line in text.split("\n")])


def _after_value(code: str, before: bool) -> bool:
    tail = code.rstrip()
    if not tail:
        return before
    return (tail[-1].isalnum() or tail[-1] in "_$)]\"'`") and not _BEFORE_PATTERN.search(tail[-16:])


def lex(text: str, language: str, state: str = "", comments: list | None = None, closed: list | None = None) -> tuple[str, str]:
    """(text with strings and comments blanked, the state at its end).

    Every character stands where it stood; a string keeps its quotes. ``comments`` gets the
    (begin, end) of every comment, ``closed`` those of all stretches that lie in a string, a
    comment or a template. A one-line string that isn't closed ends with its line.
    """
    stack = state.split(" ") if state else []
    value = "." in stack
    if value:
        stack.remove(".")
    out, at, n = [], 0, len(text)
    script = language == "javascript"
    since = 0 if stack else None

    def comment(a, z):
        out.append(_blank(text[a:z]))
        if comments is not None:
            comments.append((a, z))

    while at < n:
        if closed is not None and (since is None) == bool(stack):
            if since is not None:
                closed.append((since, at))
            since = at if stack else None
        top = stack[-1] if stack else ""
        if top.startswith("/*"):
            depth, z = int(top[2:]), at
            while True:
                m = _NESTED.search(text, z)
                if not m:
                    z = n
                    break
                z = m.end()
                if m.group() == "*/":
                    depth -= 1
                elif language == "rust" or not depth:
                    depth += 1
                if not depth:
                    break
            stack[-1:] = [f"/*{depth}"] if depth else []
            comment(at, z)
            at = z
        elif top == "`":
            z = _TEMPLATE.match(text, at).end()
            out.append(_blank(text[at:z]))
            if z < n and text[z] == "`":
                out.append("`")
                stack.pop()
                z, value = z + 1, True
            elif z < n:
                out.append("  "[: n - z])
                stack.append("{0")
                z, value = min(n, z + 2), False
            at = z
        elif top and top[0] in "\"'r":
            if top[0] == "r":
                z = text.find(top[1:], at)
                z, close = (n, "") if z < 0 else (z, top[1:])
            else:
                rule = _TRIPLE[top[0]] if len(top) == 3 else _INNER[top] if language == "rust" else _ONE_LINE[top]
                z = min(n, rule.match(text, at).end())
                close = top if text.startswith(top, z) else ""
            out.append(_blank(text[at:z]) + close)
            at = z + len(close)
            # an open one-line string goes on only behind a backslash at the line's end
            if close or (len(top) == 1 and language != "rust" and at < n):
                stack.pop()
                value = True
        else:
            m = (_IN_TEMPLATE if top else TOKEN[language]).search(text, at)
            a = m.start() if m else n
            out.append(text[at:a])
            if script:
                value = _after_value(text[at:a], value)
            if not m:
                break
            t, at = m.group(), m.end()
            if t.startswith("//") or t[0] == "#":
                comment(a, at)
            elif t == "/*":
                stack.append("/*0")
                at = a
            elif t == "/":
                p = None if value else _PATTERN.match(text, a)
                at = p.end() if p else at
                out.append(_blank(p.group()) if p else "/")
                value = bool(p)
            elif t in "{}":
                depth = int(top[1:]) + (1 if t == "{" else -1)
                out.append(t if depth >= 0 else " ")
                stack[-1:] = [f"{{{depth}"] if depth >= 0 else []
                value = False
            elif t[-1] in "\"'`" and not (language == "rust" and "'" in t):
                quote = t.lstrip("rRbBuUfFtTcC")
                raw = language == "rust" and "r" in t[: len(t) - len(quote.lstrip("#"))]
                if raw:
                    quote = '"' + "#" * quote.count("#")
                    out.append(" " * (len(t) - 1) + '"')
                    stack.append("r" + quote)
                else:
                    out.append(" " * (len(t) - len(quote)) + quote)
                    stack.append(quote)
            else:  # a rust character, or the sign of a lifetime
                out.append(t[0] + _blank(t[1:-1]) + t[-1] if len(t) > 1 else t)
    if closed is not None and (stack or since is not None):
        closed.append((n if since is None else since, n))
    if stack and len(stack[-1]) == 1 and stack[-1] in "\"'" and language != "rust" and not text.endswith("\\\n"):
        stack.pop()  # not closed, and its line is over
    if script and value and not (stack and stack[-1] not in ("/*1",) and not stack[-1].startswith("{")):
        stack.insert(0, ".")
    return "".join(out), " ".join(stack)


_MARK = {"java": re.compile(r"[\[\](){};]"), "rust": re.compile(r"[\[\](){};]"), "javascript": re.compile(r"[\[\](){};,]|\n")}
_SOLID = re.compile(r"\S")
_ATTRIBUTES = re.compile(r"(?:#!?\s*\[(?:[^\[\]]|\[[^\]]*\])*\]\s*)+")
_EXPORT = re.compile(r"export\s+(?:default\s+)?")
# a line of JavaScript that goes on: it ends in an operator or one of these words
_GOES_ON = re.compile(r"(?:[^\w$)\]}\"'`\s]|(?:^|[^\w$])(?:static|async|get|set|class|extends|export|default|function|return|new|in|of|instanceof|else|typeof|await|yield))\s*$")
_BEGINS = re.compile(r"\s*(?!(?:extends|instanceof|in|of)\b)[\w$#\[*@\"']")
#: what a statement must look like to be kept: headers of definitions, not of other blocks
_STATEMENT = r"(?:if|for|while|switch|catch|with|try|do|else|synchronized|return|new|throw|case|assert|yield|loop|match|unsafe\s*$)\b"
WORTH = {
    "java": re.compile(rf"(?!{_STATEMENT})[^=]*(?:\b(?:class|enum|record)\b|\)\s*(?:\[\s*\]\s*)*(?:throws\b[^;]*)?$)", re.S),
    "javascript": re.compile(rf"(?!{_STATEMENT})(?:class\b|.*\)\s*$)", re.S),
    "rust": re.compile(r".*\b(?:fn|struct)\b", re.S),
}


_NAMED = re.compile(r"\b(?:class|struct|fn|enum|record)\s+")


def clean_cuts(text: str, masked: str, language: str, closed: list) -> dict[int, int]:
    """Depth -> the first line begin of that bracket depth (counted from 0 at the begin of the text)
    where a file may be cut: outside strings and comments, between two statements, in
    Python before a line without indentation."""
    out: dict[int, int] = {}
    depth, at, i, ended = 0, 0, 0, False
    for line in masked.split("\n")[:-1]:
        z = at + len(line) + 1
        code = line.rstrip()
        if language == "python":
            if depth not in out and at and not ended and code and not line[0].isspace():
                while i < len(closed) and closed[i][1] <= at:
                    i += 1
                if i == len(closed) or closed[i][0] >= at:
                    out[depth] = at
            ended = code.endswith("\\")
        depth += sum(map(line.count, "([{")) - sum(map(line.count, ")]}"))
        at = z
        if language != "python" and depth not in out and code and code[-1] in "};":
            while i < len(closed) and closed[i][1] < at:
                i += 1
            if (i == len(closed) or closed[i][0] >= at) and at < len(text):
                out[depth] = at
    return out


def statements(text: str, masked: str, language: str, comments: list) -> list[tuple]:
    """(begin, end, head, stop, comment, name) of every statement that may head a definition.

    ``head`` is the masked text of the statement at its own bracket level, what lies inside its
    brackets left out; ``stop`` the ``{`` or ``;`` behind it; ``end`` the place after the bracket that
    closes its block (after the ``;``); ``comment`` the comments that stand right above it;
    ``name`` a place on the line of the name that it defines.
    """
    mark, worth = _MARK[language], WORTH[language]
    out, open_at = [], []
    levels = [[0, [], 0, 0]]  # per open bracket: begin of the statement, its pieces, end of the last piece, last "("
    starts = [a for a, _ in comments]

    def emit(p, stop):
        sep, pieces, last, bracket = levels[-1]
        first = _SOLID.search(masked, sep, p)
        if not first:
            return None
        a = first.start()
        if language == "rust":
            m = _ATTRIBUTES.match(masked, a, p)
            a = m.end() if m else a
        elif language == "javascript":
            m = _EXPORT.match(masked, a, p)
            a = m.end() if m else a
        head = "".join(pieces) + masked[last:p]
        head = head.strip()
        if language == "rust":
            head = re.sub(r"^(?:#!?\s*\[\]\s*)+", "", head)
        elif language == "javascript":
            head = _EXPORT.sub("", head, count=1) if head.startswith("export") else head
        if not worth.match(head):
            return None
        # a comment on the line of the statement before belongs to that one
        line_end = sep if not sep or text[sep - 1] == "\n" else text.find("\n", sep)
        lo = bisect_left(starts, line_end if line_end >= 0 else len(text))
        above = [text[x:z] for x, z in comments[lo : bisect_right(starts, a)] if language != "java" or text.startswith("/*", x)]
        named = _NAMED.search(masked, a, p)
        out.append([a, p + 1, head, stop, "\n".join(above).strip(), named.end() if named else max(a, bracket - 1)])
        return len(out) - 1

    def begin(p):
        levels[-1][:] = [p, [], p, p]

    for m in mark.finditer(masked):
        c, p = m.group(), m.start()
        if c in "([":
            levels[-1][1].append(masked[levels[-1][2] : p + 1])
            levels[-1][2] = p + 1
            if c == "(":
                levels[-1][3] = p
            levels.append([p + 1, [], p + 1, p + 1])
            open_at.append(None)
        elif c == "{":
            open_at.append((emit(p, "{"),))
            levels.append([p + 1, [], p + 1, p + 1])
        elif c in ")]}":
            if not open_at:
                continue
            found = open_at.pop()
            levels.pop()
            if found is None:
                levels[-1][2] = p
            else:
                if found[0] is not None:
                    out[found[0]][1] = p + 1
                begin(p + 1)
        elif c == ";":
            emit(p, ";")
            begin(p + 1)
        elif c == ",":
            begin(p + 1)
        else:  # the end of a line ends a JavaScript statement that could end there
            sep = levels[-1][0]
            so_far = masked[sep:p]
            if (open_at and open_at[-1] is None) or not so_far.strip():
                continue
            nxt = _SOLID.search(masked, p)
            if nxt and not _GOES_ON.search(so_far[-24:]) and _BEGINS.match(masked, nxt.start()):
                begin(p + 1)
    for found in open_at:  # blocks that nothing closes reach the end
        if found and found[0] is not None:
            out[found[0]][1] = len(masked.rstrip())
    return [tuple(s) for s in out]


_PY_HEAD = re.compile(r"[ \t]*(?:(?:async[ \t]+)?def|class)[ \t]+[^\W\d]\w*")
_PY_BRACKET = re.compile(r"[\[\](){}:]")
_PY_STRING = re.compile(r"[rRuUbBfFtT]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')")


def python_lines(masked: str) -> list[tuple]:
    """(begin, end, depth, inside a string) of every line; depth and string state at its begin."""
    out, depth, at, inside = [], 0, 0, ""
    for line in masked.split("\n"):
        out.append((at, at + len(line), depth, inside))
        depth = max(0, depth + sum(map(line.count, "([{")) - sum(map(line.count, ")]}")))
        for q in re.findall("\"\"\"|'''", line):
            inside = "" if inside == q else inside or q
        at += len(line) + 1
    return out


def python_statements(text: str, masked: str) -> list[tuple]:
    """As ``statements``, for blocks by indentation; the comment is the string that opens the body."""
    out, blocks, content = [], [], 0
    ready = None
    went_on = False
    for a, z, depth, inside in python_lines(masked):
        line = masked[a:z]
        code = line.strip()
        if not inside and depth == 0 and code and not went_on:
            indent = len(line) - len(line.lstrip(" \t"))
            while blocks and blocks[-1][0] >= indent:
                out[blocks.pop()[1]][1] = content
            m = _PY_HEAD.match(line)
            if m:
                ready = len(out)
                blocks.append((indent, ready))
                out.append([a + indent, z, m.group().strip(), ":", "", a + indent])
                out[-1][4] = _docstring(text, masked, a + m.end())
        if code or (inside and text[a:z].strip()):
            content = a + len((text if inside and not code else masked)[a:z].rstrip())
        went_on = not inside and line.rstrip().endswith("\\") and text[a:z].rstrip().endswith("\\")
    for _, i in blocks:
        out[i][1] = content
    return [tuple(s) for s in out]


def _docstring(text: str, masked: str, at: int) -> str:
    depth = 0
    for m in _PY_BRACKET.finditer(masked, at):
        c = m.group()
        if c == ":" and not depth:
            body = re.compile(r"(?:\s|#[^\n]*)*").match(text, m.end()).end()
            s = _PY_STRING.match(text, body)
            return s.group() if s else ""
        depth += (c in "([{") - (c in ")]}")
    return ""


_IMPORT = {
    "python": re.compile(r"^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]*(\([^)]*\)|[^\n(]+)|^[ \t]*import[ \t]+([^\n]+)", re.M),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", re.M),
    "javascript": re.compile(r"\bimport\s+(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\}|\*\s*as\s+([\w$]+))?\s*from\s*[\"'](\s*)[\"']"),
    "rust": re.compile(r"\buse\s+([\w:]+?)(?:::\{([^}]*)\})?(?:\s+as\s+(\w+))?\s*;"),
}
_AS = re.compile(r"([\w$]+)(?:\s+as\s+([\w$]+))?\s*$")


def _stem(module: str) -> str:
    parts = [x for x in re.split(r"[./\\:]+", re.sub(r"\.(?:js|mjs|py|rs)$", "", module.strip())) if x]
    return parts[-1] if parts else ""


def imports(text: str, masked: str, language: str) -> list[tuple]:
    """(alias, name, module) per imported name: the name it has here, the name it has there
    (``""`` for a module as a whole) and the last part of the module's path."""
    out = []

    def each(names, module):
        for one in names.strip("() \t\n").split(","):
            m = _AS.match(one.strip())
            if m:
                out.append((m.group(2) or m.group(1), m.group(1), module))

    for m in _IMPORT[language].finditer(masked):
        if language == "python" and m.group(1):
            each(m.group(2), _stem(m.group(1)))
        elif language == "python":
            for one in m.group(3).split(","):
                path, _, alias = one.strip().partition(" as ")
                out.append((alias.strip() or path.strip(), "", _stem(path)))
        elif language == "java":
            path = m.group(1).split(".")
            out.append((path[-1], path[-1], path[-2] if len(path) > 1 and path[-2][:1].isupper() else path[-1]))
        elif language == "javascript":
            module = _stem(text[m.start(4) : m.end(4)])
            if m.group(1):
                out.append((m.group(1), m.group(1), module))
            if m.group(2):
                each(m.group(2), module)
            if m.group(3):
                out.append((m.group(3), "", module))
        else:
            path = [x for x in m.group(1).split("::") if x]
            if m.group(2):
                each(m.group(2), path[-1])
            elif path:
                out.append((m.group(3) or path[-1], path[-1], path[-2] if len(path) > 1 else ""))
    return out
