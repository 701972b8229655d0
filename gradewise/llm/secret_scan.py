"""Secret scans with assignment-aware lexing.

Base patterns are searched over each whole text. Beside them, a text that has an assignment sign and a
part of a sensitive name is lexed as a whole into strings (of one line, of several, with prefixes), names,
signs, brackets and line ends. Every name, quoted name or subscript that a sign follows becomes a
name-literal pair, past type annotations, parentheses, calls and line breaks: its value is a string,
several that are joined (by a sign or by standing together), a bare value, a block scalar or a here
document. Elements and attributes of markup are pairs, too. A literal in nested braces, brackets or
indented keys also counts for the name of what holds it where its own name says nothing.

Names in a value, also inside a string, are looked up among the constants that the text assigns in
the scopes which are open there (braces, and indented bodies of functions and classes): the latest
before, else the first after. So a literal is also judged by the names that it reaches, over any number
of steps. Literals are scored by how sensitive their target names are and by how random they look;
those above a threshold are added as spans of kind ``lexed``, unless they lie in a base span. Parts
that are joined make one span.

The job is one narrow pass without a shuffle; texts are independent.

Defined results: a null or empty text has no spans and the digest of the empty string; repeated
rows each give a row; null ids pass through; an empty table gives an empty result; other columns
are ignored by the query. Offsets are code points, ends exclusive. Spans that start together stand
in the order of KINDS. A string that is not closed on its line (or at all, for long ones) is no string.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradewise.llm.common import map_texts, table

KINDS = ("assign", "access", "hex", "lexed")
#: Fixed patterns of the base kinds, and the least length of what each must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
HEX_MARKS = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))

#: How sensitive a part of a name is; a name counts for its most sensitive part or pair of parts.
NAMES = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "api key": 1.0, "access key": 1.0, "private key": 1.0, "secret key": 1.0, "encryption key": 1.0, "signing key": 1.0, "auth key": 1.0, "account key": 1.0, "client secret": 1.0,
    "auth": 0.7, "authorization": 0.7, "bearer": 0.7, "pass": 0.7, "salt": 0.5, "signature": 0.5, "key": 0.4,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "sample", "todo", "none", "null", "true", "false", "xxxx", "****")
THRESHOLD = 0.5
MIN_LITERAL = 8

#: Names that say nothing of their own: the name of what holds them counts.
GENERIC = {"value", "val", "default", "data", "content", "text", "string", "str", "body", "plain", "raw", "v", "item", "items", "values", "stringdata"}
#: Names of types that may stand after a variable's name.
TYPES = {"string", "str", "byte", "bytes", "rune", "char", "varchar", "text"}
#: Beginnings of the names of functions whose first argument says what to look up.
LOOKUPS = ("get", "read", "load", "fetch", "find", "lookup", "env", "has", "is", "require", "import", "open", "len", "print", "log", "test", "assert")
#: Every name of NAMES holds one of these.
STEMS = re.compile(rb"pass|pwd|secret|token|key|cred|auth|bearer|salt|signature", re.IGNORECASE)

TOKEN = re.compile(
    r"""(?P<triple>(?:(?<!\w)[rRbBuUfF]{1,2})?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|\'\'\'(?:[^\\]|\\.)*?\'\'\'))
    |(?P<double>(?:(?<!\w)(?:[rRbBuUfF]{1,2}|\$@?|@\$?))?"[^"\\\n]*(?:\\.[^"\\\n]*)*")
    |(?P<single>(?<!\w)(?:[rRbBuUfF]{1,2})?'[^'\\\n]*(?:\\.[^'\\\n]*)*')
    |(?P<name>(?<!\w)[A-Za-z_$][\w$]*(?:(?:\.|::|->|-)[A-Za-z_$][\w$]*)*)
    |(?P<compare>={2,3}|!==?|<=|>=|=~|::)
    |(?P<sign>:=|=>|<-|\?=|\+=|=|:)
    |(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<line>\n)|(?P<joint>\.\.|[+.&~])|(?P<end>[;,])""",
    re.ASCII | re.DOTALL | re.VERBOSE,
)
STRINGS = {"triple", "double", "single"}
BLANKS = re.compile(r"[^\S\n]*")
BARE = re.compile(r"[^\s\"',;(){}\[\]<>|`]+")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*", re.ASCII)
ANNOTATION = re.compile(r"[^\S\n]*+[A-Za-z_*&][\w.*&?<>,|\[\]\x20]*+=(?![=>])", re.ASCII)
LEVELS = re.compile(r"\.|::|->")
DIGIT = re.compile("[0-9]")
BLOCK = re.compile(r"[|>][+-]?\d*[+-]?[^\S\n]*(?:#[^\n]*)?\n")
HERE = re.compile(r"<<[-~]?[\x20]*([\"']?)(\w+)\1[^\n]*\n")
REFERENCE = re.compile(r"[$#%]?\{\{?\s*([A-Za-z_][\w.]*)\s*\}?\}|\$([A-Za-z_]\w*)|%\(([A-Za-z_]\w*)\)s", re.ASCII)
SCHEME = re.compile(r"(?:bearer|basic|token)\s+", re.IGNORECASE)
BODY = re.compile(r"(?:async[^\S\n]+)?(?:def|class)\b")
ELEMENT = re.compile(r"""<([A-Za-z_][\w.:-]*)((?:\s+[\w.:-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*)\s*(?:/>|>(?:\s*(?:<!\[CDATA\[)?([^<>]*)</\1\s*>)?)""", re.ASCII)
ATTRIBUTE = re.compile(r"""([\w.:-]+)\s*=\s*(?:"([^"<]*)"|'([^'<]*)')""", re.ASCII)
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z \x20]*PRIVATE KEY-----[^-]+-----END [A-Z \x20]*PRIVATE KEY-----")
URL_SECRET = re.compile(r"://[^\s:/@\"']+:([^\s@/\"']+)@")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def sensitivity(name: str) -> float:
    """How sensitive a target name is, from 0 to 1, by its parts (camelCase, snake_case, dots)."""
    parts = [p if p in NAMES or p[:-1] not in NAMES else p[:-1] for p in map(str.lower, PARTS.findall(name))]
    pairs = [f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)]
    return max((NAMES.get(p, 0.0) for p in parts + pairs), default=0.0)


def is_placeholder(literal: str) -> bool:
    """Whether a literal in lower case has a placeholder as a word of its own, alone or before a
    sensitive name, or stands for hidden characters."""
    if any(p in literal for p in PLACEHOLDERS if not p.isalpha() or p == "xxxx"):
        return True
    words = re.findall("[a-z]+", literal)
    return any(w == p or (w.startswith(p) and w[len(p) :] in NAMES) for w in words for p in PLACEHOLDERS)


def randomness(literal: str) -> float:
    """How random a literal looks, from 0 to 1: its entropy per character, by length and character
    kinds; 0 for placeholders and prose."""
    if len(literal) < MIN_LITERAL or " " in literal or "://" in literal or is_placeholder(literal.lower()):
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(bool(re.search(k, literal)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 3.5) * (1.0 if kinds > 1 else 0.6)


#: A part of a value: a name that is to be looked up (or ""), and the place of a literal (or -1, -1).
#: One that has both is a literal only where no such name is known.
Part = tuple[str, int, int]


class Lexer:
    """The name-literal pairs of a text, and the spans that they give. Each step takes time in
    proportion to the text."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text)]
        #: (names, parts of the value, place, scope) of each pair.
        self.pairs: list[tuple[tuple[str, ...], list[Part], int, int]] = []
        #: By scope (the place where it opens; -1 is the whole text) the one around it.
        self.around = {-1: -1}
        #: By name and scope the pairs that assign it, in order.
        self.constants: dict[tuple[str, int], list[int]] = {}
        self.missing: set[str] = set()
        self._walk()
        self.known = {name for name, _ in self.constants}

    def _string(self, i: int) -> tuple[int, int]:
        """The place of a string's content."""
        kind, a, b = self.tokens[i]
        quote = 3 if kind == "triple" else 1
        while self.text[a] not in "\"'":
            a += 1
        return a + quote, b - quote

    def _is(self, i: int, *kinds: str) -> bool:
        return i < len(self.tokens) and self.tokens[i][0] in kinds

    def _after_lines(self, i: int) -> int:
        while self._is(i, "line"):
            i += 1
        return i

    def _walk(self) -> None:
        text, tokens = self.text, self.tokens
        held: list[tuple[str, str, int]] = []  # of each open bracket: its name, the nearest name, the scope outside
        keys: list[tuple[int, str]] = []  # indented keys that hold what follows
        bodies: list[tuple[int, int]] = []  # indentation, and scope outside, of function and class bodies
        scope, waiting, callee, first, start = -1, "", "", True, 0
        for i, (kind, a, b) in enumerate(tokens):
            if kind == "line":
                first, start = True, b
                continue
            if first:
                indent, first = a - start, False
                while bodies and bodies[-1][0] >= indent:
                    scope = bodies.pop()[1]
                while keys and keys[-1][0] >= indent:
                    keys.pop()
                if kind == "name" and BODY.match(text, a):
                    bodies.append((indent, scope))
                    self.around[a], scope = scope, a
            if kind == "open":
                name = waiting or callee
                held.append((name, name or (held[-1][1] if held else ""), scope))
                if text[a] == "{":
                    self.around[a], scope = scope, a
                waiting = callee = ""
                continue
            if kind == "close":
                if held:
                    scope = held.pop()[2]
                continue
            callee = text[a:b] if kind == "name" and text[b : b + 1] == "(" else ""
            if callee.rpartition(".")[2].lower().startswith(LOOKUPS):
                callee = ""
            if kind != "name" and kind not in STRINGS:
                continue
            own = self._string(i) if kind in STRINGS else (a, b)
            name, sign = text[slice(*own)], self._sign(i)
            if sign is None:
                if kind in STRINGS and held and held[-1][0] and not (self._is(i - 1, "joint") or self._is(i + 1, "joint")):
                    self.pairs.append(((held[-1][0],), [("", *own)], a, scope))
                continue
            names = [name]
            if i and name.lower() in TYPES and tokens[i - 1][0] == "name" and not text[tokens[i - 1][2] : a].strip("[]* \t"):
                names.append(text[slice(*tokens[i - 1][1:])])
            holder = (held[-1][1] if held else "") or (keys[-1][1] if keys else "")
            if name.lower() in GENERIC and holder:
                names.append(holder)
            parts = self._value(sign)
            if isinstance(parts, str):
                if parts == "indented":
                    keys.append((a - start, name))
                waiting = names[-1] if parts == "bracket" else ""
            elif parts:
                for n in {n.lstrip("$") for x in names for n in (x, LEVELS.split(x)[-1])}:
                    self.constants.setdefault((n, scope), []).append(len(self.pairs))
                self.pairs.append((tuple(names), parts, a, scope))

    def _sign(self, i: int) -> int | None:
        """The sign after a name or a string, past a subscript's bracket and a type."""
        text, tokens, j = self.text, self.tokens, i + 1
        while self._is(j, "close") and text[tokens[j][1]] == "]":
            j += 1
        if not self._is(j, "sign") or text[tokens[j - 1][2] : tokens[j][1]].strip(" \t\r!?*") or text[tokens[j][1] : tokens[j][2]] == "<-":
            return None
        if text[tokens[j][1] : tokens[j][2]] == ":" and (m := ANNOTATION.match(text, tokens[j][2])):
            k = j
            while self._is(k, "sign", "name", "open", "close", "end", "line", "joint", "compare") and tokens[k][2] < m.end():
                k += 1
            return k if self._is(k, "sign") and tokens[k][2] == m.end() else j
        return j

    def _lines(self, at: int, end: int, indent: int = -1) -> list[Part]:
        """The lines between two places up to the first that is not indented by more than ``indent``."""
        out: list[Part] = []
        while at < end:
            stop = self.text.find("\n", at, end)
            stop = end if stop < 0 else stop
            line = self.text[at:stop]
            if line.strip():
                if len(line) - len(line.lstrip()) <= indent:
                    break
                out.append(("", at + len(line) - len(line.lstrip()), at + len(line.rstrip())))
            at = stop + 1
        return out

    def _here(self, m: re.Match) -> list[Part]:
        """The lines of a here document; none where its end is missing."""
        if m[2] in self.missing:
            return []
        if end := re.compile(rf"^[^\S\n]*{m[2]}\b", re.MULTILINE).search(self.text, m.end()):
            return self._lines(m.end(), end.start())
        self.missing.add(m[2])
        return []

    def _value(self, sign: int) -> list[Part] | str:
        """The parts of what is assigned; "bracket" or "indented" where pairs of their own follow."""
        text, tokens = self.text, self.tokens
        colon, p, i = text[tokens[sign][1] : tokens[sign][2]] == ":", tokens[sign][2], sign + 1
        q = BLANKS.match(text, p).end()
        if colon and (m := BLOCK.match(text, q)):
            line = text[text.rfind("\n", 0, p) + 1 : p]
            return self._lines(m.end(), len(text), len(line) - len(line.lstrip(" \t-")))
        if m := HERE.match(text, q):
            return self._here(m)
        if q >= len(text) or text[q] in "\r\n\\":
            i = self._after_lines(i)
            if not self._is(i, *STRINGS) or self._is(i + 1, "sign"):
                return "indented" if colon and text[q : q + 1] != "\\" else []
            q = tokens[i][1]
        elif text[q] in "{[":
            return "bracket"
        if i >= len(tokens) or tokens[i][1] > q or tokens[i][0] in ("joint", "sign", "compare"):
            return self._bare(q)
        parts: list[Part] = []
        depth, lookup, joined = 0, False, True
        while i < len(tokens):
            kind, a, b = tokens[i]
            if kind == "line":
                j = self._after_lines(i)
                if not (depth or joined or self._is(j, "joint") or text[a - 1] == "\\"):
                    break
                i = j
                continue
            if kind in STRINGS:
                if depth and self._is(i + 1, "sign"):
                    break
                if not lookup or self._is(i + 1, "joint"):
                    parts.append(("", *self._string(i)))
                lookup = joined = False
            elif kind == "name":
                if text[b : b + 1] == "(":
                    lookup = text[a:b].rpartition(".")[2].lower().startswith(LOOKUPS)
                elif self._is(i + 1, "sign") and not text[b : tokens[i + 1][1]].strip():
                    break
                elif not parts and not depth:
                    parts += self._bare(a)
                    end = BARE.match(text, a).end()
                    while i + 1 < len(tokens) and tokens[i + 1][1] < end:
                        i += 1
                    joined = False
                elif joined or depth:
                    parts.append((text[a:b].lstrip("$"), -1, -1))
                    joined = False
                elif text[a:b].lower() not in ("or", "and"):
                    break
            elif kind == "open" and text[a] == "(":
                depth += 1
            elif kind == "close" and depth:
                depth -= 1
            elif kind == "joint" or (kind == "end" and depth and text[a] == ","):
                joined = True
            else:
                break
            i += 1
        return parts

    def _bare(self, at: int) -> list[Part]:
        """A value without quotes: a name to look up, a literal, or either."""
        m = BARE.match(self.text, at)
        if not m or self.text[m.end() : m.end() + 1] == "(":
            return []
        if r := REFERENCE.fullmatch(m[0]):
            return [(next(filter(None, r.groups())), -1, -1)]
        if IDENTIFIER.fullmatch(m[0]):
            return [(m[0].lstrip("$"), *(m.span() if DIGIT.search(m[0]) else (-1, -1)))]
        return [("", *m.span())]

    def _assigned(self, name: str, k: int) -> int | None:
        """The pair that a name in pair ``k`` stands for: assigned last before it, else first after
        it, in the innermost open scope that assigns it."""
        for n in (name, LEVELS.split(name)[-1]):
            if n in self.known:
                scope = self.pairs[k][3]
                while True:
                    if places := self.constants.get((n, scope)):
                        i = bisect_left(places, k)
                        if i:
                            return places[i - 1]
                        if after := [x for x in places[:2] if x != k]:
                            return after[0]
                    if scope == -1:
                        break
                    scope = self.around[scope]
        return None

    def _read(self, k: int) -> tuple[list[tuple[int, int]], list[int], list[tuple[str, int]]]:
        """Of a pair: its literals, the pairs that it refers to, and its value as literal texts by turns with these."""
        literals, refers, value = [], [], []
        for name, a, b in self.pairs[k][1]:
            to = self._assigned(name, k) if name else None
            if to is not None:
                refers.append(to)
                value.append(("", to))
            elif a >= 0:
                literals.append((a, b))
                last = a
                for m in REFERENCE.finditer(self.text, a, b):
                    to = self._assigned(next(filter(None, m.groups())), k)
                    if to is not None:
                        refers.append(to)
                        value += [(self.text[last : m.start()], -1), ("", to)]
                        last = m.end()
                value.append((self.text[last:b], -1))
        return literals, refers, value

    def spans(self) -> list[tuple[int, int, float]]:
        """(start, end, score) of the literals that score above the threshold."""
        text, found = self.text, {}
        read = [self._read(k) for k in range(len(self.pairs))]
        own = [max(map(sensitivity, names)) for names, *_ in self.pairs]
        # The most sensitive name that reaches each pair, over names that stand for each other.
        weight: dict[int, float] = {}
        for k in sorted(range(len(own)), key=lambda k: -own[k]):
            todo = [k] if own[k] else []
            while todo:
                x = todo.pop()
                if x not in weight:
                    weight[x] = own[k]
                    todo += read[x][1]

        def judge(w: float, value: str, places: list[tuple[int, int]]) -> None:
            if (score := w * randomness(value)) >= THRESHOLD:
                for place in places:
                    found[place] = max(score, found.get(place, 0.0))

        plain = ["".join(text[a:b] for a, b in literals) for literals, _, _ in read]
        for k, w in weight.items():
            literals, _, value = read[k]
            joined = [(literals[0][0], literals[-1][1])] if literals and any(x for x, _ in value) else []
            others = [place for _, to in value if to >= 0 for place in read[to][0]] if len(value) > 1 else []
            judge(w, "".join(x if to < 0 else plain[to] for x, to in value), joined + others)
            for a, b in literals:
                if len(literals) > 1:
                    judge(w, text[a:b], [(a, b)])
                if m := SCHEME.match(text, a, b):
                    judge(w, text[m.end() : b], [(m.end(), b)])
        return [(a, b, s) for (a, b), s in found.items()]


def marked_up(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the secrets in elements and their attributes."""
    out = []
    for m in ELEMENT.finditer(text):
        attributes = {a[1].lower(): a for a in ATTRIBUTE.finditer(text, *m.span(2))}
        value = lambda a: a[2] if a[2] is not None else a[3]
        names = [m[1], *(value(attributes[k]) for k in ("key", "name", "id") if k in attributes)]
        places = [attributes[k].span(2 if attributes[k][2] is not None else 3) for k in ("value", "content") if k in attributes]
        if m[3]:
            body = m[3].replace("]]>", "")
            a = m.start(3) + len(body) - len(body.lstrip())
            places.append((a, a + len(body.strip())))
        weight = max(map(sensitivity, names))
        out += [(a, b, s) for a, b in places if (s := weight * randomness(text[a:b])) >= THRESHOLD]
    return out


def lexed(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals of a text that score above the threshold; of those that lie
    in each other the widest."""
    found = Lexer(text).spans()
    if "</" in text or "/>" in text:
        found += marked_up(text)
    if "PRIVATE KEY" in text:
        found += [(*m.span(), 1.0) for m in PRIVATE_KEY.finditer(text)]
    if "://" in text:
        found += [(*m.span(1), s) for m in URL_SECRET.finditer(text) if (s := randomness(m[1])) >= THRESHOLD]
    out: list[tuple[int, int, float]] = []
    for a, b, s in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or b > out[-1][1]:
            out.append((a, b, s))
    return out


def base_spans(raw: bytes, text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base kinds."""
    out = []
    low = raw.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"x" * LEAST["hex"] in raw.translate(HEX_MARKS):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def spans(raw: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, of a UTF-8 text as (start, kind's place, end)."""
    text = raw.decode()
    base = base_spans(raw, text)
    signs = any(x in raw for x in (b"=", b":", b"</", b'("', b"('"))
    named = signs and (STEMS.search(raw) or (b"://" in raw and b"@" in raw))
    if not named and b"PRIVATE KEY-----" not in raw:  # a key block needs neither name nor sign
        return base, base
    more = [(a, 3, b) for a, b, _ in lexed(text) if not any(x <= a and b <= y for x, _, y in base)]
    return base, sorted(base + more) if more else base


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(raw: bytes, mark: str = "[SECRET]") -> str:
    """The text with each span (overlapping ones as one) replaced by a mark."""
    text = raw.decode()
    out, at = [], 0
    for a, _, b in spans(raw)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256 and spans."""

    def make() -> Callable:
        def apply(texts: list[bytes]) -> list:
            out: list[list] = [[] for _ in range(5)]
            for raw in texts:
                base, every = spans(raw)
                n = Counter(k for _, k, _ in base)
                for x, y in zip(out, (n[0], n[1], n[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)), strict=True):
                    x.append(y)
            return out

        return apply

    return map_texts(docs, make, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", keep, text)


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with every span in the text replaced by a mark, in a column ``redacted``."""
    return map_texts(docs, lambda: lambda texts: [[redacted(t, mark) for t in texts]], "redacted string", keep, text)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


QUERIES = {"op6_secret_scan": op6_secret_scan}
