"""Globs as regular expressions, which Java's and Python's engines read alike.

A glob may hold braces (nested, over slashes, ranges), `*` and `?` within a segment, `**` over segments, classes with
POSIX names, groups of alternatives (`?(a|b)`, `*(…)`, `+(…)`, `@(…)`, `!(…)`), a leading `!` that turns it round, or be a
comment. Names that begin with a dot count like others; case matters.
"""

from __future__ import annotations

import re

# What POSIX names of classes mean, and whether it is what they leave out.
POSIX = {
    "alnum": (r"\p{L}\p{Nl}\p{Nd}", False), "alpha": (r"\p{L}\p{Nl}", False), "ascii": (r"\x00-\x7f", False), "blank": (r"\p{Zs}\t", False),
    "cntrl": (r"\p{Cc}", False), "digit": (r"\p{Nd}", False), "graph": (r"\p{Z}\p{C}", True), "lower": (r"\p{Ll}", False), "print": (r"\p{C}", True),
    "punct": (r"\p{P}", False), "space": (r"\p{Z}\t\r\n\x0b\f", False), "upper": (r"\p{Lu}", False), "word": (r"\p{L}\p{Nl}\p{Nd}\p{Pc}", False), "xdigit": ("A-Fa-f0-9", False),
}
#: The most globs that braces of one glob may stand for.
MOST = 100_000
_END = "(?!.)"
_NO_DOTS = rf"(?!\.\.?(?:/|{_END}))(?=[^/])"
# Braces that stand for themselves, while others are expanded.
_OPEN, _CLOSE = "\ue000", "\ue001"


def _pair(text: str) -> tuple[int, int] | None:
    """The first pair of braces that no other encloses; where an opening one stays alone, the first of those closed."""
    opened: list[int] = []
    first: tuple[int, int] | None = None
    for k, c in enumerate(text):
        if c == "{":
            opened.append(k)
        elif c == "}" and opened:
            begin = opened.pop()
            if not opened:
                return begin, k
            if first is None or begin < first[0]:
                first = begin, k
    return first


def _options(body: str) -> list[str]:
    """Split at the commas that no braces enclose."""
    out, depth = [""], 0
    for c in body:
        depth += (c == "{") - (c == "}")
        if c == "," and depth <= 0:
            out.append("")
        else:
            out[-1] += c
    return out


def _range(body: str) -> list[str] | None:
    """The members of a..b or a..b..step, of whole numbers or of letters."""
    if found := re.fullmatch(r"(-?\d+)\.\.(-?\d+)(?:\.\.(-?\d+))?", body):
        low, high, numbers = int(found[1]), int(found[2]), True
    elif found := re.fullmatch(r"([a-zA-Z])\.\.([a-zA-Z])(?:\.\.(-?\d+))?", body):
        low, high, numbers = ord(found[1]), ord(found[2]), False
    else:
        return None
    step = max(1, abs(int(found[3] or 1)))
    members = range(low, high + 1, step) if low <= high else range(low, high - 1, -step)
    if not numbers:
        return ["" if chr(n) == "\\" else chr(n) for n in members[:MOST]]
    padded = any(re.match(r"-?0\d", found[k]) for k in (1, 2))
    width = max(len(found[1]), len(found[2])) if padded else 0
    return [f"{n:0{width}d}" for n in members[:MOST]]


def _expanded(text: str, top: bool) -> list[str]:
    pair = _pair(text)
    if pair is None:
        return [text]
    before, body, after = text[: pair[0]], text[pair[0] + 1 : pair[1]], text[pair[1] + 1 :]
    tails = lambda: _expanded(after, False) if after else [""]
    if before.endswith("$"):
        return [f"{before}{{{body}}}{tail}" for tail in tails()][:MOST]
    members = _range(body)
    if members is None and "," not in body:
        # Braces around one thing stand for themselves; what follows is read on if it could be an option list.
        if re.search(r",(?!,).*\}", after):
            return _expanded(f"{before}{{{body}{_CLOSE}{after}", top)
        return [text]
    if members is None:
        options = _options(body)
        if len(options) == 1:  # its commas stand in inner braces
            members = [f"{{{x}}}" for x in _expanded(options[0], False)]
            if not after:
                return [before + x for x in members]
        else:
            members = [x for option in options for x in _expanded(option, False)]
    out: list[str] = []
    ends = tails()
    for x in members:
        for tail in ends:
            if len(out) >= MOST:
                return out
            if not top or _range(body) is not None or before + x + tail:
                out.append(before + x + tail)
    return out


def expand(glob: str) -> list[str]:
    """The globs that one with braces stands for, in order."""
    if not re.search(r"\{[^{]*\}", glob):
        return [glob]
    if glob.startswith("{}"):
        glob = _OPEN + _CLOSE + glob[2:]
    return [x.replace(_OPEN, "{").replace(_CLOSE, "}") for x in _expanded(glob, True)]


def _in_class(char: str) -> str:
    return "\\" + char if char in "\\[]^-&~" else char


def _class(text: str, at: int) -> tuple[str, int] | None:
    """The class that opens at text[at] and where it ends; None if it does not."""
    k = at + 1
    around = k < len(text) and text[k] in "!^"
    k += around
    first, inside, outside = k, "", ""
    while k < len(text):
        c = text[k]
        if c == "]" and k > first:
            break
        if named := re.match(r"\[:(\w+):\]", text[k:]):
            if named[1] in POSIX:
                members, left_out = POSIX[named[1]]
                inside, outside = (inside, outside + members) if left_out else (inside + members, outside)
                k += named.end()
                continue
        if text[k + 1 : k + 2] == "-" and text[k + 2 : k + 3] not in ("", "]"):
            if c <= text[k + 2]:
                inside += f"{_in_class(c)}-{_in_class(text[k + 2])}"
            k += 3
            continue
        inside += _in_class(c)
        k += 1
    else:
        return None
    sets = [f"[{'^' if around else ''}{inside}]"] * bool(inside) + [f"[{'' if around else '^'}{outside}]"] * bool(outside)
    return (rf"(?!/)(?:{'|'.join(sets)})" if sets else "(?!)"), k + 1


def _parse(text: str, at: int, inner: bool) -> tuple[list, int] | None:
    """Pieces of a segment from `at` on: strings that are expressions already, or (kind, alternatives). Within a group
    it ends at | or ); None if neither comes."""
    out: list = []
    while at < len(text):
        c = text[at]
        if inner and c in "|)":
            return out, at
        if c in "?*+@!" and text[at + 1 : at + 2] == "(" and (group := _group(text, at)):
            out.append(group[0])
            at = group[1]
        elif c == "*":
            while text[at : at + 1] == "*" and not (text[at + 1 : at + 2] == "(" and _group(text, at)):
                at += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
            at += 1
        elif c == "[" and (found := _class(text, at)):
            out.append(found[0])
            at = found[1]
        else:
            out.append(re.escape(c))
            at += 1
    return None if inner else (out, at)


def _group(text: str, at: int) -> tuple[tuple[str, list], int] | None:
    kind, alternatives, at = text[at], [], at + 2
    while (found := _parse(text, at, True)) is not None:
        alternatives.append(found[0])
        at = found[1] + 1
        if text[found[1]] == ")":
            return (kind, alternatives), at
    return None


def _written(pieces: list, after: str) -> str:
    """The pieces as one expression; after: what follows them in the segment, which `!(…)` has to look at."""
    out = ""
    for piece in reversed(pieces):
        if isinstance(piece, str):
            one = piece
        else:
            kind, alternatives = piece
            body = "|".join(_written(a, out + after) for a in alternatives)
            if kind == "!":
                one = f"(?:(?!(?:{body}){out}{after}(?:/|{_END}))[^/]*)" if any(alternatives) else "[^/]+"
            else:
                one = f"(?:{body}){'' if kind == '@' else kind}"
        out = one + out
    return out


def is_plain(segment: str) -> bool:
    """Whether a segment stands for itself only."""
    return not re.search(r"[*?\[]|[+@!]\(", segment)


def _segment(text: str) -> str:
    return re.escape(text) if is_plain(text) else _NO_DOTS + _written(_parse(text, 0, False)[0], "")


def segments(glob: str) -> list[str]:
    """Of a glob without braces; a `..` takes the plain segment before it away, `**` beside `**` is one."""
    out: list[str] = []
    for part in re.split("/+", glob):
        if part == "**" and out and out[-1] == "**":
            continue
        if part == ".." and out and out[-1] not in ("", ".", "..", "**"):
            out.pop()
            continue
        out.append(part)
    return out or [""]


def _one(glob: str) -> str:
    parts, out = segments(glob), ""
    for k, part in enumerate(parts):
        if part == "**":
            out += ".*" if k == len(parts) - 1 else "(?:[^/]*/)*"
        else:
            out += _segment(part) + ("" if k == len(parts) - 1 else "/")
    return out


def turned(glob: str) -> tuple[bool, str]:
    """Whether marks at its beginning turn a glob round, and the glob without them."""
    bare = glob.lstrip("!")
    return (len(glob) - len(bare)) % 2 == 1, bare


def regex(glob: str) -> str | None:
    """An expression for whole paths, to be put between ^ and the end; None for what fits nothing."""
    if not glob or glob.startswith("#"):
        return None
    around, bare = turned(glob)
    found = "|".join(dict.fromkeys(map(_one, expand(bare))))
    return f"(?!(?:{found})/?{_END}).*" if around else f"(?:{found})/?"


def whole(expressions: list[str]) -> str:
    return f"(?s)^(?:{'|'.join(expressions)}){_END}" if expressions else ""


def of_pattern(pattern: str) -> tuple[list[str], list[str]]:
    """What a pattern of a setting or rule means for a path and for its base name, as lists of expressions: it fits a
    path, the base name, a directory above it, and, without a slash, any segment, as a glob or as it is written."""
    pattern = re.sub(r"^\./", "", pattern.strip().replace("\\", "/"))
    if not pattern:
        return [], []
    forms = [pattern, f"{pattern}/**"]
    literal = []
    if "/" not in pattern:
        forms += [f"**/{pattern}", f"**/{pattern}/**"]
        literal = [f"(?:.*/)?{re.escape(pattern)}(?:/.*)?"]
    found = [r for r in map(regex, forms) if r is not None]
    base = regex(pattern)
    return found + literal, [base] if base else []


def keys(pattern: str) -> list[str]:
    """What a path must have one of for the pattern to fit it: a directory or file that it lies at or below (d:), a name
    of one of its segments (s:), the ending of one (e:), or nothing that could be looked up (any)."""
    pattern = re.sub(r"^\./", "", pattern.strip().replace("\\", "/"))
    if not pattern or turned(pattern)[0]:
        return ["any"]
    out = [f"s:{pattern}"] if "/" not in pattern else []
    for one in expand(turned(pattern)[1]):
        parts = segments(one)
        plain = [is_plain(p) and p != "" for p in parts]
        ending = re.search(r"(\.[\w-]+)$", parts[-1])
        if len(parts) > 1 and plain[0]:
            out.append("d:" + "/".join(parts[: plain.index(False) if False in plain else len(parts)]))
        elif True in plain:
            out.append("s:" + parts[plain.index(True)])
        elif ending and parts[-1] != "**":
            out.append("e:" + ending[1])
        else:
            return ["any"]
    return list(dict.fromkeys(out))
