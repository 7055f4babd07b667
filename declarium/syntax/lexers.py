"""Token classes of source texts, by language.

Each text is cut by one compiled pattern; the class of a token's text is remembered. A text that
holds a character no token begins with, or a literal that never ends, has a token of class ``BAD``,
which no grammar takes. Comments and blanks give no tokens.
"""

from __future__ import annotations

import re

#: Language by file ending.
ENDINGS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "rs": "rust", "java": "java", "sh": "bash", "bash": "bash",
}


def language_of(file: str | None) -> str | None:
    """The language that a file's ending says, or None."""
    name = (file or "").strip().rsplit("/", 1)[-1].lower()
    return ENDINGS.get(name.rsplit(".", 1)[-1]) if "." in name else None


def plain(text: str) -> str:
    """The text without a byte-order mark, its line ends as line feeds."""
    if text[:1] == "﻿":
        text = text[1:]
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


#: Class of comments; they are no tokens, but documentation.
COMMENT = "//"


class _Classes(dict):
    """Class of a piece of text, by the piece: None for blanks. Bounded, as literals differ without end."""

    def __init__(self, classify, comments: tuple[str, ...] = ()):
        super().__init__()
        self.classify, self.comments = classify, comments

    def __missing__(self, text: str) -> str | None:
        if len(self) > 150_000:
            self.clear()
        bare = text.rstrip(" \t\f\v\r") if text[:1] == "\n" else text.rstrip()
        if self.comments and bare.startswith(self.comments):
            found = COMMENT
        else:
            found = self.classify(bare)
        self[text] = found
        return found


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_ID = r"[^\W\d]\w*"

# Python ------------------------------------------------------------------------------------------

_PY_STRING = (
    r"(?:[rRbBuUfFtT]{0,2}(?:'''(?:[^\\']|\\.|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\""
    r"|'(?!'')(?:[^\\'\n]|\\.)*'|\"(?!\"\")(?:[^\\\"\n]|\\.)*\"))"
)
_PY_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"
PY = re.compile(
    rf"[ \t\f]+|\#[^\n]*|\\\n|(\n(?:[ \t\f]*(?:\#[^\n]*)?\n)*[ \t\f]*|{_PY_STRING}|{_ID}|{_PY_NUMBER}|\.\.\.|->|:=|\*\*=?|//=?|<<=?|>>=?|[=!<>]=|[-+*/%&|^@]=|[-+*/%&|^@~<>=,:;.()\[\]{{}}]|.)",
    re.S,
)
_PY_KEY = _words("and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type")


def _py_class(t: str) -> str:
    c = t[0]
    if t in _PY_KEY:
        return t
    if t in ("None", "True", "False"):
        return "CONST"
    if len(t) > 1 and t[-1] in "'\"":
        return "STR"
    if c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
        return "BAD" if re.match(r"0[\d_]*[1-9]", t) and not re.search(r"[.eEjJ]|0[xXoObB]", t) else "NUM"
    if t in ("<", ">", "==", ">=", "<=", "!="):
        return "COMPARE"
    if t in ("+", "/", "//", "%", "@", "&", "|", "^", "<<", ">>"):
        return t if t in ("@", "|", "/", "+") else "ARITH"
    if t == "~":
        return "UNARY"
    if len(t) > 1 and t[-1] == "=" and t not in (":=",):
        return "OPASSIGN"
    if t.isidentifier():
        return "ID"
    return t if t in ("...", "->", ":=", "**", "*", "-", "=", ",", ":", ";", ".", "(", ")", "[", "]", "{", "}") else "BAD"


_PY_CLASSES = _Classes(_py_class)


def python(text: str) -> list[str]:
    out: list[str] = []
    add = out.append
    depth = 0
    indents = [0]
    get = _PY_CLASSES.__getitem__
    first = re.match(r"(?:[ \t\f]*(?:#[^\n]*)?\n)*([ \t\f]*)", text)
    if first and first.group(1) and first.end() < len(text) and text[first.end()] not in "#\n":
        return ["BAD"]
    for t in PY.findall(text[first.end() :] if first else text):
        if not t:
            continue
        if t[0] == "\n":
            if depth or not out:
                continue
            width = 0
            for c in t[t.rfind("\n") + 1 :]:
                width = width + 1 if c == " " else (width // 8 + 1) * 8 if c == "\t" else 0
            add("NEWLINE")
            if width > indents[-1]:
                indents.append(width)
                add("INDENT")
            else:
                while width < indents[-1]:
                    indents.pop()
                    add("DEDENT")
                if width != indents[-1]:
                    add("BAD")
            continue
        c = get(t)
        if c in ("(", "[", "{"):
            depth += 1
        elif c in (")", "]", "}"):
            depth -= 1
        add(c)
    # what a line break at the very end opened is closed again
    while out and out[-1] in ("INDENT", "DEDENT"):
        out.pop()
    if out and out[-1] != "NEWLINE" and depth <= 0:
        add("NEWLINE")
    level = out.count("INDENT") - out.count("DEDENT")
    if depth <= 0:
        out += ["DEDENT"] * level
    return out


# C-like languages --------------------------------------------------------------------------------

_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"

JS_NUMBER = r"(?:0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*n|\d[\d_]*\.?(?:[eE][+-]?\d+)?)(?![\w$])"
_JS_REGEX = r"(?:(?<=[=(,:!&|?{};\[\n+*%<>~^])|(?<=[=(,:!&|?{};\[\n+*%<>~^] )|(?<=return )|(?<=\n  )|(?<=\n    ))/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_JS_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"
# the expression literal comes before blanks, so that it sees what stands before it
JS = re.compile(
    rf"//[^\n]*|\A\#![^\n]*|{_BLOCK}|(?:{_JS_REGEX}|\n|(?:[A-Za-z_$]|[^\W\d])[\w$]*|\#[A-Za-z_$][\w$]*|{JS_NUMBER}|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|{_JS_TEMPLATE}"
    r"|=>|\.\.\.|===?|!==?|\*\*=?|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|\+\+|--|<<=?|<=|[-+*/%&|^]=|\S)[^\S\n]*|[^\S\n]+",
    re.S,
)
JS_KEY = _words(
    "async of get set from as static let await yield var const function if else while do for return break continue throw debugger try catch finally switch case default import export class extends new this super in instanceof with"
)
JS_SOFT = _words("type interface enum namespace module declare abstract implements readonly override keyof unique infer is asserts satisfies global")
_JS_UNARY = _words("! ~ typeof void delete")
_JS_BINARY = _words("== === != !== <= << && || ?? ** % ^")
_JS_OPASSIGN = _words("+= -= *= /= %= &= |= ^= **= <<= &&= ||= ??=")
_JS_PUNCT = _words("=> ... ?. ++ -- - + * / & | < > = ? : , ; . ( ) [ ] { } @ !")


def _js_class(typed: bool):
    def classify(t: str) -> str | None:
        if not t:
            return None
        if t == "\n":
            return "NL"
        c = t[0]
        if t in JS_KEY:
            return t
        if t in ("null", "true", "false"):
            return "CONST"
        if typed:
            if t in ("public", "private", "protected"):
                return "ACCESS"
            if t in JS_SOFT:
                return t
            if t == "!":
                return "!"
        if t in ("typeof", "void") and typed:
            return t
        if t in _JS_UNARY:
            return "UNARY"
        if t in _JS_BINARY:
            return "BINARY"
        if t in _JS_OPASSIGN:
            return "OPASSIGN"
        if t in _JS_PUNCT:
            return t
        if c in "\"'":
            return "STR" if len(t) > 1 else "BAD"
        if c == "`":
            return "TEMPLATE" if len(t) > 1 else "BAD"
        if c == "#":
            return "PRIVATE"
        if c.isdigit() or c == "." and len(t) > 1:
            return "NUM"
        if c == "/" and len(t) > 1:
            return "REGEX"
        return "ID" if c == "_" or c == "$" or c.isalpha() else "BAD"

    return classify


_SLASHES = ("//", "/*")
SCRIPT = {typed: _Classes(_js_class(typed), (*_SLASHES, "#!")) for typed in (False, True)}


_GO_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?i?|\.\d[\d_]*(?:[eE][+-]?\d+)?i?)(?!\w)"
GO = re.compile(
    rf"//[^\n]*|{_BLOCK}|(?:\n|{_ID}|{_GO_NUMBER}|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:x..|u.{{4}}|U.{{8}}|\d{{3}}|.))'|\.\.\.|:=|\+\+|--|<-|&&|\|\||<<=?|>>=?|&\^=?|[-+*/%&|^<>=!]=|\S)[^\S\n]*|[^\S\n]+",
    re.S,
)
_GO_KEY = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
_GO_BINARY = _words("+ / % == != < > <= >= && || << >> &^")
_GO_OPASSIGN = _words("+= -= *= /= %= &= |= ^= <<= >>= &^=")
_GO_PUNCT = _words("... := ++ -- <- * - & | ~ = , ; . : ( ) [ ] { }")
_GO_ENDS = frozenset(["ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def _go_class(t: str) -> str | None:
    if not t:
        return None
    if t == "\n":
        return "NL"
    c = t[0]
    if t in _GO_KEY or t in _GO_PUNCT:
        return t
    if t in ("!", "^"):
        return "UNARY" if t == "!" else "^"
    if t in _GO_BINARY:
        return "BINARY"
    if t in _GO_OPASSIGN:
        return "OPASSIGN"
    if c in "\"`'":
        return "STR" if len(t) > 1 else "BAD"
    if c.isdigit() or c == ".":
        return "NUM"
    return "ID" if c == "_" or c.isalpha() else "BAD"


_GO_CLASSES = _Classes(_go_class, _SLASHES)

_RS_NUMBER = r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[ui](?:8|16|32|64|128|size)|f32|f64)?(?!\w)"
RUST = re.compile(
    rf"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/|(?:b?r\"[^\"]*\"|b?r\#\".*?\"\#|b?r\#\#\".*?\"\#\#|[bc]?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\(?:x..|u\{{[^}}]*\}}|[^xu]))'|'{_ID}(?!')|(?:r\#)?{_ID}|{_RS_NUMBER}|\.\.=|\.\.\.|\.\.|::|->|=>|&&|\|\||<<=|<=|<<|[-+*/%&|^=!]=|\S)\s*|\s+",
    re.S,
)
_RS_KEY = _words("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while _")
_RS_BINARY = _words("/ % ^ == != <= << += -= *= /= %= &= |= ^= <<=")
_RS_PUNCT = _words(".. ..= ... :: -> => && || + - * & | < > = ! , ; . : ? # @ $ ~ ( ) [ ] { }")


def _rs_class(t: str) -> str | None:
    if not t or t[0] == "\n":
        return None
    c = t[0]
    if t in _RS_KEY or t in _RS_PUNCT:
        return t
    if t in ("true", "false"):
        return "BOOL"
    if t in _RS_BINARY:
        return "BINARY"
    if t[-1] == '"' or (len(t) > 1 and t[-1] == "#"):
        return "STR" if len(t) > 1 else "BAD"
    if t[-1] == "'":
        return "CHAR" if len(t) > 1 else "BAD"
    if c == "'":
        return "LIFETIME"
    if c.isdigit():
        return "NUM"
    return "ID" if c == "_" or c.isalpha() else "BAD"


_RS_CLASSES = _Classes(_rs_class, _SLASHES)
rust_class = _RS_CLASSES.__getitem__

_JAVA_NUMBER = r"(?:0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdD]?|\d[\d_]*\.?(?:[eE][+-]?\d+)?[fFdDlL]?)(?!\w)"
JAVA = re.compile(
    rf"//[^\n]*|{_BLOCK}|(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|\"(?!\"\")(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\(?:u+.{{4}}|[0-7]{{1,3}}|.))'|non-sealed(?![\w$])|(?:[A-Za-z_$]|[^\W\d])[\w$]*|{_JAVA_NUMBER}|\.\.\.|::|->|\+\+|--|&&|\|\||<<=?|<=|[=!]=|[-+*/%&|^]=|\S)\s*|\s+",
    re.S,
)
_JAVA_KEY = _words("assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface new package return static super switch synchronized this throw throws try void while record var yield sealed permits module when")
_JAVA_PRIM = _words("boolean byte char double float int long short")
_JAVA_MODIFIER = _words("public private protected abstract native strictfp transient volatile")
_JAVA_BINARY = _words("* / % == != <= << && || ^ |")
_JAVA_OPASSIGN = _words("+= -= *= /= %= &= |= ^= <<=")
_JAVA_PUNCT = _words("... :: -> ++ -- & < > = ? , ; . : @ ( ) [ ] { }")


def _java_class(t: str) -> str | None:
    if not t or t[0] == "\n":
        return None
    c = t[0]
    if t in _JAVA_KEY:
        return "ID" if t == "module" else t
    if t in _JAVA_PRIM:
        return "PRIM"
    if t in _JAVA_MODIFIER or t == "non-sealed":
        return "MODIFIER"
    if t in ("true", "false", "null"):
        return "BOOL"
    if t in ("goto", "const", "_"):
        return "BAD"
    if t in ("|", "*"):
        return t
    if t in ("+", "-"):
        return "SIGN"
    if t in ("!", "~"):
        return "UNARY"
    if t in _JAVA_BINARY:
        return "BINARY"
    if t in _JAVA_OPASSIGN:
        return "OPASSIGN"
    if t in _JAVA_PUNCT:
        return t
    if c == '"':
        return "STR" if len(t) > 1 else "BAD"
    if c == "'":
        return "CHAR" if len(t) > 1 else "BAD"
    if c.isdigit() or c == ".":
        return "NUM"
    return "ID" if c in "_$" or c.isalpha() else "BAD"


_JAVA_CLASSES = _Classes(_java_class, _SLASHES)

# Shell -------------------------------------------------------------------------------------------

_SH_HEREDOC = re.compile(r"(?<!<)<<(-?)(?!<)[ \t]*(?:'([^'\n]+)'|\"([^\"\n]+)\"|\\?([\w.-]+))")


def _shell_pattern(depth: int) -> re.Pattern:
    """The token pattern, with quotes and substitutions inside each other down to ``depth`` levels."""
    back = r"`(?:[^`\\]|\\.)*+`"
    quoted = r"\"(?:[^\"\\]|\\.)*+\""
    paren = rf"\((?:[^()'\"`\\]|\\.|'[^']*'|{quoted}|{back})*+\)"
    for _ in range(depth):
        brace = rf"\$\{{(?:[^{{}}'\"`\\$]|\\.|'[^']*'|{quoted}|{back}|\${paren}|\$\{{[^{{}}]*\}}|\$)*+\}}"
        quoted = rf"\"(?:[^\"\\$`]|\\.|\${paren}|{brace}|\$(?![({{])|{back})*+\""
        paren = rf"\((?:[^()'\"`\\]|\\.|'[^']*'|{quoted}|{back}|{paren})*+\)"
    return re.compile(
        rf"""
        (?<![^\s;&|()])\#[^\n]*
        | (?P<t> \n | ;;&? | ;& | \|\| | && | \|& | [;&|](?!>)
          | \d*(?:<<<|<<-?|<>|>>|>\||<&|>&|[<>])(?!\() | &>>?
          | \(\((?:[^()'\"]|{paren}|\"[^\"]*\"|'[^']*')*+\)\)
          | [A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=\((?=[^(])
          | [()]
          | (?:[^\s'\"\\$`;&|<>()]+ | \\[^\n] | '[^']*' | {quoted} | {back} | \${paren} | {brace} | \$'(?:[^'\\]|\\.)*' | \$(?![('{{]) | [<>]{paren} )+
          | \S )[ \t]*
        | [ \t]+ | \\\n
        """,
        re.X | re.S,
    )


SHELL = _shell_pattern(2)
_SH_KEY = _words("if then elif else fi for in do done while until case esac function { } ! time select coproc [[ ]]")


def _sh_class(t: str) -> str:
    if t == "\n":
        return "NL"
    if t in _SH_KEY or t in ("|", "||", "&&", "|&", "&", ";", "(", ")"):
        return t
    if t in (";;", ";&", ";;&"):
        return "DSEMI"
    if t.startswith("((") and t.endswith("))"):
        return "ARITH"
    if re.fullmatch(r"\d*(?:<<<|<>|>>|>\||<&|>&|[<>])|&>>?", t):
        return "REDIRECT"
    if re.fullmatch(r"\d*<<-?", t):
        return "HEREDOC"
    if re.fullmatch(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=\(", t):
        return "ARRAY"
    if re.match(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=", t):
        return "ASSIGN"
    if t in ("'", '"', "`", "$") or (len(t) == 1 and t in "<>"):
        return "BAD"
    return "NAME" if re.fullmatch(r"[A-Za-z_][\w.:-]*", t) else "WORD"


_SH_CLASSES = _Classes(_sh_class)
shell_class = _SH_CLASSES.__getitem__


def blank_heredocs(text: str) -> str:
    """The text with blanks in place of its here-documents, so that all offsets stay."""
    return _without_heredocs(text, blank=True)


def _without_heredocs(text: str, blank: bool = False) -> str:
    """The text without the bodies of its here-documents; a body that never ends goes to the end."""
    if "<<" not in text:
        return text
    out, waiting = [], []
    for line in text.split("\n"):
        if waiting:
            dash, word = waiting[0]
            if (line.lstrip("\t") if dash else line) == word:
                waiting.pop(0)
            if blank:
                out.append(" " * len(line))
            continue
        bare = line
        if "<<" in line and not line.lstrip().startswith("#"):
            for m in _SH_HEREDOC.finditer(line):
                if line[: m.start()].count('"') % 2 == 0 and not re.search(r"\(\([^)]*$", line[: m.start()]):
                    waiting.append((m.group(1), m.group(2) or m.group(3) or m.group(4)))
            if waiting:
                bare = _SH_HEREDOC.sub(lambda m: "<<" + " " * (len(m.group(0)) - 2), line)
        out.append(bare)
    return "\n".join(out)


def bash(text: str) -> list[str]:
    if text[:2] == "#!":
        text = text[text.find("\n") :] if "\n" in text else ""
    get = _SH_CLASSES.__getitem__
    return [get(t) for t in SHELL.findall(_without_heredocs(text)) if t]


def go_semicolons(found: list[str]) -> list[str]:
    """The classes with a semicolon where a line ends after a token that can end a statement."""
    out: list[str] = []
    last = ""
    for c in found:
        if c == "NL":
            if last in _GO_ENDS:
                out.append(";")
            last = ""
        else:
            out.append(c)
            last = c
    if last in _GO_ENDS:
        out.append(";")
    return out


# All ---------------------------------------------------------------------------------------------


def _pieces(language: str) -> tuple[re.Pattern, _Classes]:
    return {
        "go": (GO, _GO_CLASSES),
        "rust": (RUST, _RS_CLASSES),
        "java": (JAVA, _JAVA_CLASSES),
        "javascript": (JS, SCRIPT[False]),
        "typescript": (JS, SCRIPT[True]),
    }[language]


def pieces(language: str, text: str) -> tuple[list[str | None], list[str]]:
    """The text cut without a gap into tokens with the blanks after them, comments and blanks; and their classes."""
    pattern, classes = _pieces(language)
    found = pattern.findall(text)
    return list(map(classes.__getitem__, found)), found


def tokens(language: str, text: str) -> list[str]:
    """The token classes of ``plain`` text."""
    if language == "python":
        return python(text)
    if language == "bash":
        return bash(text)
    found = [c for c in pieces(language, text)[0] if c and c is not COMMENT]
    return go_semicolons(found) if language == "go" else found
