"""One tolerant lexer for all languages: every character ends up in a token, white space or a comment."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    type: str  # id num str chr op com pp end
    text: str
    start: int
    end: int
    nl: bool  # first on its line


_OPS = sorted(
    """>>>= <<= >>= ... ..= ..< === !== ** -> => :: ++ -- << >> <= >= == != && || ?? ?. ?: += -= *= /= %= &= |= ^= := :> <: .. <- /= !! ~= // \\ """.split(),
    key=len,
    reverse=True,
)
_STR = r'"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)'
_TRIPLE = r'"""(?:[^\\]|\\.)*?(?:"""|\Z)'
_IDENT = r"[^\W\d]\w*"


def _spec(lang: str) -> list[tuple[str, str]]:
    hash_comment = r"\#[^\n]*"
    slash = r"//[^\n]*|/\*(?:.*?)(?:\*/|\Z)"
    chars = r"'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)"
    if lang == "python":
        return [("com", hash_comment), ("str", r"(?:[rRbBuUfF]{0,2})(?:'''(?:[^\\]|\\.)*?(?:'''|\Z)|" + _TRIPLE + "|" + _STR + "|" + chars + ")")]
    if lang == "lua":
        return [("com", r"--\[(?P<lc>=*)\[.*?(?:\](?P=lc)\]|\Z)|--[^\n]*"), ("str", r"\[(?P<ls>=*)\[.*?(?:\](?P=ls)\]|\Z)|" + _STR + "|" + chars)]
    if lang == "ada":
        return [("com", r"--[^\n]*"), ("str", r'"(?:[^"\n]|"")*(?:"|(?=\n)|\Z)'), ("chr", r"'[^\n]'")]
    if lang == "fortran":
        return [("com", r"![^\n]*"), ("str", r"\"[^\"\n]*(?:\"|(?=\n)|\Z)|'[^'\n]*(?:'|(?=\n)|\Z)")]
    spec = [("com", slash)]
    if lang == "php":
        spec = [("com", slash + r"|\#(?!\[)[^\n]*"), ("str", _STR.replace(r"\n", "") + "|" + chars.replace(r"\n", ""))]
    elif lang in ("c", "cpp"):
        spec += [("pp", r"(?m:^)[ \t]*\#(?:[^\\\n/]|/(?![/*])|\\(?:\r?\n|.))*"), ("str", r'(?:u8|[uUL])?(?:R"(?P<rd>[^()\s]{0,16})\(.*?\)(?P=rd)"|' + _STR + ")"), ("chr", r"(?:u8|[uUL])?" + chars)]
    elif lang == "rust":
        spec = [("com", r"//[^\n]*|/\*(?:.*?)(?:\*/|\Z)"), ("str", r'b?r(?P<rh>\#*)".*?"(?P=rh)|b?"(?:[^"\\]|\\.)*(?:"|\Z)'), ("chr", r"b?'(?:[^'\\\n]|\\.[^'\n]*)'"), ("life", r"'" + _IDENT)]
    elif lang == "go":
        spec += [("str", r"`[^`]*(?:`|\Z)|" + _STR), ("chr", chars)]
    elif lang in ("javascript", "typescript", "tsx"):
        spec += [("str", r"`(?:[^`\\]|\\.)*(?:`|\Z)|" + _STR + "|" + chars)]
    elif lang == "csharp":
        spec += [("pp", r"(?m:^)[ \t]*\#[^\n]*"), ("str", r'[$@]{1,2}"(?:[^"]|"")*(?:"|\Z)|' + _TRIPLE + "|" + _STR), ("chr", chars)]
    elif lang == "swift":
        spec += [("str", _TRIPLE + "|" + _STR)]
    else:
        spec += [("str", _TRIPLE + "|" + _STR), ("chr", chars)]
    return spec


_CACHE: dict[str, re.Pattern] = {}


def lexer(lang: str) -> re.Pattern:
    if lang not in _CACHE:
        ident = r"[$@]?" + _IDENT + r"\$?" if lang == "php" else r"[$@\#]?" + _IDENT if lang in ("javascript", "typescript", "tsx") else r"@?" + _IDENT if lang == "csharp" else r"`[^`\n]+`|" + _IDENT if lang in ("kotlin", "swift", "scala") else r"\#?" + _IDENT if lang == "swift" else _IDENT
        ops = [o for o in _OPS if not (o == "//" and lang not in ("python",)) and not (o == "\\" and lang != "php") and not (o == "/=" and False) and not (lang in ("ada", "fortran") and o in ("/*",))]
        if lang == "ada":
            ops = ["=>", "..", "**", ":=", "/=", ">=", "<=", "<<", ">>", "<>"]
        if lang == "fortran":
            ops = ["**", "//", "==", "/=", "<=", ">=", "=>", "::", "(/", "/)"]
        if lang == "lua":
            ops = ["...", "..", "==", "~=", "<=", ">=", "//", "::", "<<", ">>"]
        # '>>' would swallow the ends of two type argument lists
        ops = [o for o in ops if o not in (">>", ">>=", ">>>=") or lang in ("c", "python", "lua", "ada", "php", "go")]
        parts = [f"(?P<{t}>{p})" for t, p in _spec(lang)]
        parts += [r"(?P<num>\d(?:[eEpP][+-]\d|[\w']|\.(?=\d))*)" if lang in ("c", "cpp") else r"(?P<num>\d(?:[eE][+-]\d|\w|\.(?=\d))*)", f"(?P<id>{ident})", "(?P<op>" + "|".join(re.escape(o) for o in ops) + r"|[^\s])"]
        _CACHE[lang] = re.compile("|".join(parts), re.S)
    return _CACHE[lang]


def tokens(source: str, lang: str) -> list[Token]:
    out, last_end, nl = [], 0, True
    for m in lexer(lang).finditer(source):
        kind = m.lastgroup
        s, e = m.span()
        if kind in ("rd", "rh", "lc", "ls"):
            kind = {"rd": "str", "rh": "str", "lc": "com", "ls": "str"}[kind]
        nl = not out or source.find("\n", last_end, s) >= 0
        if kind == "pp":
            skip = len(m.group()) - len(m.group().lstrip())
            s += skip
        out.append(Token(kind, source[s:e], s, e, nl))
        last_end = e
    out.append(Token("end", "", len(source), len(source), True))
    return out
