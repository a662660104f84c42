"""A tolerant parser for the structure of Java sources: types, members, calls and findings.

It never fails: what it does not understand it skips to the next brace or semicolon, and
says so in `ok`. Calls in nested lambdas and anonymous classes belong to the method around.

A call's receiver is a type with steps still to be taken from it: `a.b.f()` with a local
`T a` is (T, [field b]); `x.f().g()` is (type of x, [return of f]). The steps are resolved
against all files later (see facts.build).
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>\"{3}.*?(?:\"{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<n>(?:0[xXbB][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?)|(?P<i>[^\W\d][\w$]*|\$[\w$]*)|(?P<o>->|::|\.\.\.|&&|\|\||[<>=!]=|[^\s\w])""",
    re.S | re.X,
)
MODIFIERS = set("public protected private static final abstract native synchronized transient volatile strictfp default sealed non-sealed".split())
KEYWORDS = set("if for while switch catch synchronized return new throw try else do case assert super this instanceof".split())
_BLOCKS = {"if", "for", "while", "do", "try", "switch"}


class Tokens(list):
    """(kind, text, line)"""


def lex(src: str) -> Tokens:
    out, line, last = Tokens(), 1, 0
    for m in _TOKEN.finditer(src):
        line += src.count("\n", last, m.start())
        last = m.start()
        if m.lastgroup != "c":
            out.append((m.lastgroup, m[0], line))
    return out


def bare(t: str) -> str:
    i = t.find("<")
    return t[:i] if i > 0 else t


class Parser:
    def __init__(self, src: str, invokers: tuple = ()):
        self.t = lex(src)
        self.n = len(self.t)
        self.ok = True
        self.package, self.found_imports = "", []
        self.out: dict[str, list[dict]] = {k: [] for k in ("types", "methods", "fields", "calls", "implements", "annotations", "imports", "smells")}

    # -------- looking

    def x(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < self.n else ""

    def ident(self, i: int) -> bool:
        return 0 <= i < self.n and self.t[i][0] == "i"

    def line(self, i: int) -> int:
        return self.t[min(max(i, 0), self.n - 1)][2] if self.n else 1

    def closing(self, i: int, a: str, b: str) -> int:
        """The place of the bracket that closes the one at i; the end if there is none."""
        d = 0
        while i < self.n:
            d += (self.x(i) == a) - (self.x(i) == b)
            if not d:
                return i
            i += 1
        self.ok = False
        return self.n

    def generics(self, i: int) -> int:
        """Past <...> if it is there."""
        return self.closing(i, "<", ">") + 1 if self.x(i) == "<" else i

    def type_at(self, i: int) -> tuple[str, int]:
        """A type as written, and the place after it; '' if there is none."""
        s = i
        while self.x(i) == "@":
            i = self.annotation(i)[2]
            s = i
        if not self.ident(i):
            return "", s
        i += 1
        while True:
            if self.x(i) == "<":
                i = self.generics(i)
            elif self.x(i) == "." and self.ident(i + 1):
                i += 2
            elif self.x(i) == "[" and self.x(i + 1) == "]":
                i += 2
            elif self.x(i) == "...":
                i += 1
            else:
                break
        words = [self.x(k) for k in range(s, min(i, self.n))]
        return re.sub(r"\b(extends|super)\b", r" \1 ", "".join(words)).replace(",", ", ").replace("  ", " "), i

    def name(self, i: int) -> tuple[str, int]:
        s = self.x(i)
        i += 1
        while self.x(i) == "." and (self.ident(i + 1) or self.x(i + 1) == "*"):
            s, i = s + "." + self.x(i + 1), i + 2
        return s, i

    def annotation(self, i: int) -> tuple[str, dict, int]:
        name, i = self.name(i + 1)
        attrs = {}
        if self.x(i) == "(":
            j = self.closing(i, "(", ")")
            parts, d, s = [], 0, i + 1
            for k in range(i + 1, min(j, self.n)):
                d += self.x(k) in "([{"
                d -= self.x(k) in ")]}"
                if self.x(k) == "," and not d:
                    parts.append((s, k))
                    s = k + 1
            parts.append((s, j))
            for a, b in parts:
                if a < b:
                    pair = self.ident(a) and self.x(a + 1) == "="
                    attrs[self.x(a) if pair else "value"] = "".join(self.x(k) for k in range(a + 2 if pair else a, min(b, self.n)))
            i = j + 1
        return name, attrs, i

    def modifiers(self, i: int) -> tuple[list[str], list[tuple[str, dict]], int]:
        mods, notes = [], []
        while i < self.n:
            if self.x(i) == "@" and self.x(i + 1) != "interface":
                name, attrs, i = self.annotation(i)
                notes.append((name, attrs))
            elif self.x(i) == "non" and self.x(i + 1) == "-":
                mods.append("non-sealed")
                i += 3
            elif self.x(i) in MODIFIERS and not (self.x(i) == "default" and self.x(i + 1) in (":", "->")) and not (self.x(i) == "sealed" and self.x(i + 1) in ("=", ";", ".", "(")):
                mods.append(self.x(i))
                i += 1
            else:
                break
        return mods, notes, i

    # -------- declarations

    def unit(self) -> dict:
        i = 0
        while i < self.n:
            if self.x(i) == "package" and self.ident(i + 1):
                self.package, i = self.name(i + 1)
            elif self.x(i) == "import":
                j = i + 1 + (self.x(i + 1) == "static")
                s, i = self.name(j)
                self.found_imports.append(s)
            else:
                mods, notes, j = self.modifiers(i)
                k = self.type_decl(j, mods, notes)
                if k is None:
                    if self.x(j) not in (";", ""):
                        self.ok = False
                    k = max(j, i) + 1
                i = k
        return self.out

    def type_decl(self, i: int, mods: list, notes: list) -> int | None:
        kind = self.x(i)
        if kind == "@" and self.x(i + 1) == "interface":
            j = i
            while j < self.n and self.x(j) != "{":
                j += 1
            return self.closing(j, "{", "}") + 1
        if kind not in ("class", "interface", "enum", "record") or not self.ident(i + 1):
            return None
        if kind == "record" and self.x(i + 2) not in ("(", "<"):
            return None
        name, start = self.x(i + 1), self.line(i)
        i = self.generics(i + 2)
        fields: dict[str, str] = {}
        if kind == "record" and self.x(i) == "(":
            j = self.closing(i, "(", ")")
            for t, n in self.params(i, j):
                fields[n] = t
                self.out["fields"].append({"class": name, "name": n, "type": t})
            i = j + 1
        up: dict[str, list[str]] = {"extends": [], "implements": [], "permits": []}
        while self.x(i) in up:
            word = self.x(i)
            i += 1
            while True:
                t, i = self.type_at(i)
                if t:
                    up[word].append(t)
                if self.x(i) != ",":
                    break
                i += 1
        while i < self.n and self.x(i) != "{":
            self.ok, i = False, i + 1
        end = self.closing(i, "{", "}")
        self.out["types"].append({
            "name": name, "package": self.package, "qualified": f"{self.package}.{name}" if self.package else name, "kind": kind, "is_interface": kind == "interface", "is_abstract": "abstract" in mods,
            "super_class": up["extends"][0] if up["extends"] else "", "start_line": start, "end_line": self.line(end), "modifiers": mods,
        })
        for t in up["implements"] + (up["extends"] if kind == "interface" else []):
            self.out["implements"].append({"class": name, "interface": t})
        for s in self.found_imports:
            self.out["imports"].append({"class": name, "import": s})
        self.noted(name, None, notes)
        i += 1
        if kind == "enum":
            while i < end and self.x(i) != ";":
                i = self.closing(i, self.x(i), {"(": ")", "{": "}"}[self.x(i)]) + 1 if self.x(i) in ("(", "{") else i + 1
        self.members(i, end, name, kind, fields)
        return end + 1

    def noted(self, cls: str, method: str | None, notes: list) -> None:
        for n, attrs in notes:
            value = next((attrs[k] for k in ("value", "path") if k in attrs), "")
            self.out["annotations"].append({"class": cls, "method": method, "name": n.rsplit(".", 1)[-1], "value": value.strip('"')})

    def params(self, i: int, j: int) -> list[tuple[str, str]]:
        out, i = [], i + 1
        while i < j:
            _, _, i = self.modifiers(i)
            t, k = self.type_at(i)
            if t and self.ident(k):
                n, k = self.x(k), k + 1
                while self.x(k) == "[":
                    t, k = t + "[]", k + 2
                out.append((t, n))
            i = max(k, i + 1)
            while i < j and self.x(i) != ",":
                i += 1
            i += 1
        return out

    def members(self, i: int, end: int, cls: str, kind: str, fields: dict[str, str]) -> None:
        todo = []
        while i < end:
            if self.x(i) == ";":
                i += 1
                continue
            mods, notes, j = self.modifiers(i)
            if self.x(j) == "{":  # an initialiser
                i = self.closing(j, "{", "}") + 1
                continue
            k = self.type_decl(j, mods, notes)
            if k is not None:
                i = k
                continue
            start = self.line(i)
            tp = self.generics(j)
            t, k = self.type_at(tp)
            ctor = t == cls and self.x(k) in ("(", "{")
            if ctor or (t and self.ident(k) and self.x(k + 1) == "("):
                name, k = (cls, k) if ctor else (self.x(k), k + 1)
                ps: list[tuple[str, str]] = []
                if self.x(k) == "(":
                    close = self.closing(k, "(", ")")
                    ps, k = self.params(k, close), close + 1
                while self.x(k) == "[":
                    k += 2
                thrown = []
                if self.x(k) == "throws":
                    k += 1
                    while True:
                        e, k = self.type_at(k)
                        thrown.append(e)
                        if self.x(k) != ",":
                            break
                        k += 1
                if self.x(k) == "default":
                    while k < end and self.x(k) != ";":
                        k += 1
                body = None
                if self.x(k) == "{":
                    close = self.closing(k, "{", "}")
                    body, i = (k, close), close + 1
                else:
                    i = k + 1
                sig = " ".join([*mods, *([] if ctor else [t]), f"{name}({', '.join(f'{a} {b}' for a, b in ps)})", *(["throws " + ", ".join(thrown)] if thrown else [])])
                m = {"class": cls, "name": name, "params": len(ps), "return_type": "" if ctor else t, "signature": sig, "is_public": "public" in mods or kind == "interface", "start_line": start, "end_line": self.line(i - 1), "modifiers": mods, "ctor": ctor}
                self.out["methods"].append(m)
                self.noted(cls, name, notes)
                todo.append((m, ps, body, notes))
            elif t and self.ident(k):
                while True:
                    n, k, ft = self.x(k), k + 1, t
                    while self.x(k) == "[":
                        ft, k = ft + "[]", k + 2
                    fields[n] = bare(ft) + "[]" * ft.count("[]") if "<" in ft else ft
                    self.out["fields"].append({"class": cls, "name": n, "type": fields[n]})
                    self.noted(cls, n, [x for x in notes if x[0] in ("Autowired", "Inject")])
                    d = 0
                    while k < end and not (not d and self.x(k) in (",", ";")):
                        d += self.x(k) in "([{"
                        d -= self.x(k) in ")]}"
                        k += 1
                    if self.x(k) != ",":
                        break
                    k += 1
                i = k + 1
            else:
                self.ok, i = False, max(k, j) + 1
        for m, ps, body, notes in todo:  # all fields are known now
            if body:
                self.calls(m, ps, body, fields)
            if kind in ("class", "interface") and not m["ctor"]:
                self.smells(m, ps, body, notes)

    # -------- bodies

    def locals(self, a: int, b: int) -> dict[str, str]:
        out = {}
        i = a + 1
        while i < b:
            if self.ident(i) and self.x(i) not in KEYWORDS and self.x(i - 1) not in (".", "::", "new", "@"):
                t, k = self.type_at(i)
                if t and k > i and self.ident(k) and self.x(k) != "instanceof" and self.x(k + 1) in ("=", ";", ":", ",", ")", "->", "&&", "||"):
                    if t in ("var", "final"):
                        t = self.x(k + 3) if self.x(k + 1) == "=" and self.x(k + 2) == "new" else "?"
                    if t != "?":
                        out[self.x(k)] = bare(t)
                    i = k
            i += 1
        return out

    def calls(self, m: dict, ps: list, body: tuple, fields: dict) -> None:
        a, b = body
        scope = {n: bare(t.replace("...", "[]")) for t, n in ps} | self.locals(a, b)
        cls = m["class"]

        def receiver(i: int) -> tuple[str, list]:
            """What is before the dot at i."""
            j = i - 1
            if self.x(j) == ")":
                d = 0
                while j > a:
                    d += (self.x(j) == ")") - (self.x(j) == "(")
                    if not d:
                        break
                    j -= 1
                k = j - 1
                if self.ident(k) and self.x(k) not in KEYWORDS:
                    p = k
                    while self.x(p - 1) == "." and self.ident(p - 2):
                        p -= 2
                    if self.x(p - 1) == "new":
                        return bare(self.x(k)), []
                    owner, steps = receiver(k - 1) if self.x(k - 1) == "." else (cls, [])
                    return owner, [*steps, {"kind": "return", "name": self.x(k)}]
                if self.x(k) == ">":  # new T<..>()
                    d = 0
                    while k > a:
                        d += (self.x(k) == ">") - (self.x(k) == "<")
                        if not d:
                            break
                        k -= 1
                    return (bare(self.x(k - 1)), []) if self.x(k - 2) == "new" else ("?", [])
                return "?", []
            if not self.ident(j) or self.x(j) == "super":
                return "?", []
            if self.x(j) == "this":
                return cls, []
            if self.x(j - 1) == ".":
                owner, steps = receiver(j - 1)
                if not steps and owner == cls and self.x(j - 2) == "this" and self.x(j) in fields:
                    return bare(fields[self.x(j)]), []
                return owner, [*steps, {"kind": "field", "name": self.x(j)}]
            n = self.x(j)
            return bare(scope.get(n) or fields.get(n) or n), []

        for i in range(a, min(b, self.n)):
            if self.x(i) == "new" and self.ident(i + 1):
                t, k = self.type_at(i + 1)
                if self.x(k) == "(":
                    n = bare(t).rsplit(".", 1)[-1]
                    self.out["calls"].append(self.call(m, n, [], n, i, k))
            elif self.ident(i) and self.x(i + 1) == "(" and self.x(i) not in KEYWORDS:
                p = self.x(i - 1)
                q = i
                while self.x(q - 1) == "." and self.ident(q - 2):
                    q -= 2
                if self.x(q - 1) == "new":
                    continue
                owner, steps = receiver(i - 1) if p == "." else (cls, [])
                self.out["calls"].append(self.call(m, owner, steps, self.x(i), i, i + 1))

    def call(self, m: dict, owner: str, steps: list, name: str, i: int, k: int) -> dict:
        close, d, args = self.closing(k, "(", ")"), 0, 0
        for j in range(k + 1, min(close, self.n)):
            d += self.x(j) in "([{"
            d -= self.x(j) in ")]}"
            args += self.x(j) == "," and not d
        first = self.t[k + 1] if k + 1 < self.n else ("", "", 0)
        return {
            "caller_class": m["class"], "caller": m["name"], "caller_params": m["params"], "owner": owner, "steps": steps, "callee": name,
            "callee_params": args + (close > k + 1), "line": self.line(i), "literal": first[1].strip('"') if first[0] == "s" else None,
        }

    def statements(self, a: int, b: int) -> list[str]:
        """The statements directly between the braces at a and b."""
        out, d, s = [], 0, a + 1
        for i in range(a + 1, min(b, self.n)):
            d += self.x(i) in "([{"
            d -= self.x(i) in ")]}"
            if not d and (self.x(i) == ";" or self.x(i) == "}" and self.x(i + 1) not in ("else", "catch", "finally", "while", ".", ")", ";", ",")):
                words = [self.x(k) for k in range(s, i + 1)]
                text = ""
                for w in words:
                    text += (" " if text and (re.match(r"[\w\"'$=]", w) and re.match(r"[\w=$\"']", text[-1])) else "") + w
                out.append(text)
                s = i + 1
        return [x for x in out if x != ";"]

    def smells(self, m: dict, ps: list, body: tuple | None, notes: list) -> None:
        def add(rule, severity, line, message):
            self.out["smells"].append({"rule": rule, "severity": severity, "line": line, "message": message, "class": m["class"], "method": m["name"]})

        if m["end_line"] - m["start_line"] + 1 > 30:
            add("METHOD_TOO_LONG", "INFO", m["start_line"], "more than 30 lines")
        if len(ps) > 5:
            add("TOO_MANY_PARAMETERS", "INFO", m["start_line"], f"{len(ps)} parameters")
        if not body:
            return
        a, b = body
        names = {self.x(i) for i in range(a, min(b, self.n)) if self.ident(i) and (self.x(i - 1) != "." or self.x(i - 2) == "this")}
        if "abstract" not in m["modifiers"] and not any(n == "Override" for n, _ in notes):
            for _, n in ps:
                if n not in names:
                    add("UNUSED_PARAMETER", "INFO", m["start_line"], n)
        for i in range(a, min(b, self.n)):
            w, line = self.x(i), self.line(i)
            if w == "switch" and self.x(i + 1) == "(" and self.x(i - 1) in (";", "{", "}", ")", "else", "do", ":", "->"):
                o = self.closing(i + 1, "(", ")") + 1
                c = self.closing(o, "{", "}")
                d, has = 0, False
                for k in range(o, min(c, self.n)):
                    d += self.x(k) == "{"
                    d -= self.x(k) == "}"
                    has |= d == 1 and self.x(k) == "default"
                if not has:
                    add("SWITCH_WITHOUT_DEFAULT", "WARNING", line, "no default")
            elif w == "catch" and self.x(i + 1) == "(":
                c = self.closing(i + 1, "(", ")")
                kinds = {self.x(k) for k in range(i + 2, c - 1)}
                for k in ("Exception", "Throwable", "RuntimeException"):
                    if k in kinds and "|" not in kinds and "." not in kinds:
                        add("CATCH_GENERIC_EXCEPTION", "WARNING", line, k)
                if self.x(c + 1) == "{":
                    self.catch(self.statements(c + 1, self.closing(c + 1, "{", "}")), line, add)
            elif w == "if" and self.x(i + 1) == "(":
                c = self.closing(i + 1, "(", ")")
                if self.x(c + 1) == "{" and self.x(c + 2) == "}" or self.x(c + 1) == ";":
                    add("EMPTY_IF_BODY", "WARNING", line, "empty")
            elif self.t[i][0] == "n":
                v = w.replace("_", "")
                if v not in ("0", "1", "0L", "1L", "0.0", "1.0", "0.0f", "1.0f"):
                    add("MAGIC_NUMBER", "INFO", line, v)
        for line in self.nested(a, b):
            add("DEEP_NESTING", "WARNING", line, "more than 4 levels")

    def catch(self, body: list[str], line: int, add) -> None:
        if not body:
            add("EMPTY_CATCH_BLOCK", "WARNING", line, "empty")
            return
        seen: set[str] = set()
        for s in body:
            low = s.lower()
            if "printStackTrace" in s:
                seen.add("print")
            elif s in ("continue;", "break;"):
                seen.add("continue")
            elif re.fullmatch(r'return ?(null|false|true|""|0|-1L?);', s) or re.search(r"(List|Set|Map)\.of\(\)|Collections\.empty|Optional\.empty\(\)", s):
                seen.add("default")
            elif s == "return;":
                seen.add("return")
            elif re.match(r".*(logger?|log)\.(error|warn|info|debug|trace)\(", low) or "system.err.println" in low or "system.out.println" in low:
                seen.add("log")
            elif not re.fullmatch(r"[A-Za-z_]\w* ?= ?(true|false);", s):
                return  # it is handled
        if "log" in seen or not seen:
            add("SILENT_CATCH", "WARNING", line, "logged only" if seen else "not passed on")
        if "continue" in seen:
            add("SILENT_CATCH_CONTINUE", "WARNING", line, "goes on")
        if "default" in seen:
            add("SILENT_CATCH_RETURN_DEFAULT", "WARNING", line, "returns a default")
        elif "return" in seen:
            add("SILENT_CATCH_RETURN", "INFO", line, "returns")
        if "print" in seen:
            add("CATCH_PRINT_STACKTRACE", "WARNING", line, "prints the stack trace")

    def nested(self, a: int, b: int, limit: int = 4) -> list[int]:
        """Lines where a block is more than limit control structures deep, once for each branch."""
        out, stack, i, skip = [], [], a, -1
        for i in range(a, min(b, self.n)):
            w = self.x(i)
            if w in _BLOCKS and self.ident(i) and not (w == "while" and self.x(i - 1) == "}" and self.ends_do(i)):
                depth = 1 + sum(1 for _, e in stack if e > i)
                stack = [(s, e) for s, e in stack if e > i]
                stack.append((i, self.statement_end(i)))
                if depth > limit and i > skip:
                    out.append(self.line(i))
                    skip = stack[-1][1]
        return out

    def ends_do(self, i: int) -> bool:
        c = self.closing(i + 1, "(", ")")
        return self.x(c + 1) == ";"

    def statement_end(self, i: int) -> int:
        """The last token of the statement at i."""
        w = self.x(i)
        if w in ("if", "for", "while", "switch") or w == "try" and self.x(i + 1) == "(":
            i = self.closing(i + 1, "(", ")")
        e = self.block_end(i + 1)
        while self.x(e + 1) in ("else", "catch", "finally"):
            e += 1
            if self.x(e) == "catch":
                e = self.closing(e + 1, "(", ")")
            e = self.block_end(e + 1)
        return e

    def block_end(self, i: int) -> int:
        if self.x(i) == "{":
            return self.closing(i, "{", "}")
        if self.x(i) in _BLOCKS:
            return self.statement_end(i)
        d = 0
        while i < self.n:
            d += self.x(i) in "([{"
            d -= self.x(i) in ")]}"
            if self.x(i) == ";" and not d or d < 0:
                return i
            i += 1
        return i


def parse(src: str) -> tuple[dict[str, list[dict]], bool]:
    """Everything found in one source, and whether all of it was understood."""
    p = Parser(src)
    try:
        p.unit()
    except (IndexError, RecursionError):
        p.ok = False
    return p.out, p.ok
