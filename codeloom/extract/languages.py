"""Declaration rules of the five grammars. ``extract`` gives symbols and references of one file."""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass, field

from codeloom.extract.scan import Cover, Innermost, Source, split_top
from codeloom.schemas import build_node_id

NOT_CALLS = {"if", "for", "while", "switch", "match", "return", "catch", "function", "fn", "func", "def", "class", "super", "new", "and", "or", "not", "in", "is", "lambda", "elif", "else", "await", "yield", "typeof", "sizeof", "synchronized", "assert", "del", "with", "raise", "throw", "loop", "let", "const", "var", "import", "case", "select", "go", "defer", "range", "interface", "struct", "map", "chan", "except", "print_", "do", "try"}
LITERAL = re.compile(r"""(?:[-+]?\d[\w.]*|"[^"]*"|true|false|null|undefined|True|False|None)\s*(?=[;,\n)]|$)""")

NOT_LOOKED = ("", -2)


@dataclass
class Symbol:
    kind: str
    cls: str
    name: str
    start: int
    end: int
    description: str | None = None
    signatures: list = field(default_factory=list)
    mark: str = ""


@dataclass
class Ref:
    kind: str
    cls: str
    symbol: str
    name: str
    at: int


def signature(params: list[tuple[str, str | None]], returns: str | None) -> dict:
    return {"params": [{"name": n, "type": t} for n, t in params], "returns": returns or None}


class Extractor:
    language = ""
    #: References' names are cut behind their last separator.
    separators = (".",)

    def __init__(self, text: str, compat: bool):
        self.s, self.compat = Source(text, self.language), compat
        self.symbols: list[Symbol] = []
        self.refs: list[Ref] = []
        self.spans: list[tuple[int, int, str, str]] = []  # bodies of functions: start, end, class, name
        self.names: set[int] = set()  # where declared names stand

    def add(self, kind: str, cls: str, m_name: tuple[str, int], start: int, end: int, **more) -> None:
        self.names.add(m_name[1])
        self.symbols.append(Symbol(kind, cls or "_", m_name[0], start, end, **more))

    def last(self, name: str) -> str:
        for sep in self.separators:
            name = name.rsplit(sep, 1)[-1]
        return name.strip()

    def calls(self) -> None:
        """O-45, O-46: calls inside named functions; the innermost one is the caller."""
        bodies = Innermost((a, b, (cls, name)) for a, b, cls, name in reversed(self.spans))
        # No match begins within a name: the lookbehind spares the attempts, which are many in a blanked string.
        for m in re.finditer(r"(?<![A-Za-z_$])[A-Za-z_$][\w$]*(?:\s*(?:\.|::|\?\.)\s*[A-Za-z_$][\w$]*)*(?=\s*(?:::\s*<[^<>()]*>|<[\w\s,.<>\[\]]*>)?\s*\()", self.s.code):
            text = re.sub(r"\s+", "", m.group()).replace("?.", ".")
            head = re.split(r"\.|::", text)[0]
            tail_at = m.start() + max(m.group().rfind("."), m.group().rfind(":")) + 1
            if m.start() in self.names or text in NOT_CALLS or head in NOT_CALLS and head not in ("super", "new") or tail_at in self.names:
                continue
            inside = bodies.at(m.start())
            if inside and not self.is_no_call(m.start()):
                cls, name = inside[2]
                self.refs.append(Ref("calls", cls, name, self.callee(text), m.start()))

    def callee(self, text: str) -> str:
        return self.last(text)

    def is_no_call(self, at: int) -> bool:
        """Whether what looks like a call creates an object instead."""
        return bool(re.search(r"\bnew\s+$", self.s.code[max(0, at - 40) : at]))

    def run(self) -> Extractor:
        self.declare()
        self.calls()
        self.refs.sort(key=lambda r: r.at)
        return self

    def declare(self) -> None:
        raise NotImplementedError

    def next_method(self, m: re.Match | str | None, brace: int, at: int, end: int) -> tuple[re.Match | None, int]:
        """The next method head and the next brace from ``at`` on; what was found before and still lies ahead, or was not there, is not sought again."""
        if m == "" or m and m.start() < at:
            m = self.METHOD.search(self.s.code, at, end)
        if -1 < brace < at or brace < -1:
            brace = self.s.code.find("{", at, end)
        return m, brace

    def slice(self, a: int, b: int) -> str:
        return self.s.text[a:b]


class Rust(Extractor):
    """O-36"""

    language = "rust"
    separators = ("::", ".")
    FN = re.compile(r"(?:\bpub(?:\s*\([^)]*\))?\s+)?(?:\b(?:default|async|unsafe|const|extern(?:\s*\"[^\"]*\")?)\s+)*\bfn\s+(\w+)")
    TYPE = re.compile(r"(?:\bpub(?:\s*\([^)]*\))?\s+)?\b(struct|enum|trait)\s+(\w+)")
    CONST = re.compile(r"(?:\bpub(?:\s*\([^)]*\))?\s+)?\b(?:const|static(?:\s+mut)?)\s+(\w+)\s*:")
    IMPL = re.compile(r"\bimpl\b")

    def callee(self, text: str) -> str:
        return text if self.compat else self.last(text)  # Q17

    def is_no_call(self, at: int) -> bool:
        """What stands inside a macro's brackets are tokens, not calls."""
        if not hasattr(self, "macros"):
            self.macros = Cover((m.end(), self.s.end_of(m.end() - 1)) for m in re.finditer(r"\w!\s*[(\[{]", self.s.code))
        return at in self.macros

    def doc(self, at: int) -> str | None:
        if self.compat:  # Q25: every earlier doc comment of the parent
            found = [self.s.text[a:b] for a, b in self.s.comments if b <= at and self.s.text.startswith("///", a)]
        else:
            found = self.s.comments_above(at, lambda c: c.startswith("///"), skip=r"#!?\[")
        return " ".join(c[3:].strip() for c in found) or None

    def sig(self, at: int, body: int) -> dict:
        s = self.s
        i = s.code.find("(", at)
        if i < 0 or i > body:
            return signature([], None)
        params = []
        for p in split_top(self.slice(i + 1, s.end_of(i) - 1)):
            name, sep, kind = p.partition(":")
            if sep and not re.fullmatch(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?self", name.strip()):
                params.append((name.strip(), kind.strip()))
        m = re.match(r"\s*->\s*(.*)", self.slice(s.end_of(i), body), re.S)
        returns = re.split(r"\bwhere\b", m[1])[0].strip() if m else None
        return signature(params, returns)

    def declare(self) -> None:
        s = self.s
        impls = []
        for m in self.IMPL.finditer(s.code):
            body = s.find("{;", m.end())
            if body < 0 or s.code[body] == ";":
                continue
            head = s.code[m.end() : body].strip()
            if head.startswith("<"):
                depth = 0
                for i, c in enumerate(head):
                    depth += (c == "<") - (c == ">" and head[i - 1] != "-")
                    if depth == 0:
                        head = head[i + 1 :].strip()
                        break
            head = re.split(r"\bwhere\b", head)[0].strip()
            trait, sep, kind = head.rpartition(" for ")
            kind, trait = kind.strip(), trait.strip()
            bare = re.sub(r"<.*", "", kind, flags=re.S).strip()
            plain = re.sub(r"<.*", "", trait, flags=re.S).split("::")[-1].strip()
            impls.append((body, s.end_of(body), f"{kind}<{trait if self.compat else plain}>" if sep else kind))
            if sep:
                self.refs.append(Ref("implements", "_", bare, plain, m.start()))
        braces = Innermost((o + 1, c) for o, c in s.close.items() if s.code[o] == "{")
        closed = {}  # impls by their brace
        for i, (a, _, c) in enumerate(impls):
            closed.setdefault(a, (i, c))
        unclosed = [(i, a, c) for i, (a, _, c) in enumerate(impls) if a not in s.close]
        for m in self.FN.finditer(s.code):
            brace = braces.at(m.start())
            body = s.find("{;", m.end())
            if body < 0 or s.code[body] == ";":  # Q20
                continue
            end = s.end_of(body)
            more = {"description": self.doc(m.start()), "signatures": [self.sig(m.end(), body)]}
            # The impl whose brace is the innermost one; one that is never closed goes on to the end.
            within = brace[0] - 1 if brace else -1
            owners = [(i, c) for i, a, c in unclosed if within <= a < m.start()]
            owners += [closed[within]] if within in closed else []
            if owners and (owner := min(owners)[1]):
                self.add("function", owner, (m[1], m.start(1)), m.start(), end, **more)
            self.add("function", "_", (m[1], m.start(1)), m.start(), end, **more)  # Q18, Q19
            self.spans.append((body, end, "_", m[1]))
        for m in self.TYPE.finditer(s.code):
            stop = s.find("{;", m.end())
            end = s.end_of(stop) if stop >= 0 and s.code[stop] == "{" else (stop + 1 or len(s.code))
            self.add("class", "_", (m[2], m.start(2)), m.start(), end, description=self.doc(m.start()))
        for m in self.CONST.finditer(s.code):
            stop = s.code.find(";", m.end())
            self.add("constant", "_", (m[1], m.start(1)), m.start(), stop + 1 or len(s.code), description=self.doc(m.start()))


class Python(Extractor):
    """O-37"""

    language = "python"
    HEAD = re.compile(r"(?m)^([ \t]*)(?:(async[ \t]+)?def|(class))[ \t]+(\w+)")
    CONST = re.compile(r"(?m)^([ \t]*)(\w+)[ \t]*(?::[^=\n]+)?=(?!=)[ \t]*(.*)$")

    def __init__(self, text: str, compat: bool):
        super().__init__(text, compat)
        s = self.s
        self.ended = s.code + "\n"
        self.string_starts = [a for a, _ in s.strings]
        self.brackets = Cover((o + 1, c + 1) for o, c in s.close.items())
        self.within_strings = Cover((a + 1, b) for a, b in s.strings)
        self.long_strings = Cover((a + 1, b) for a, b in s.strings if b - a > 2 and "\n" in text[a:b])

    def block_end(self, at: int, indent: int) -> int:
        """Behind the last line of the block whose header begins at ``at``."""
        s = self.s
        colon = s.find(":", at)
        end = s.line_start(len(s.text)) if colon < 0 else colon
        stop = s.code.find("\n", end)
        last = len(s.text) if stop < 0 else stop
        at = last + 1
        while at < len(s.code):
            stop = s.code.find("\n", at)
            stop = len(s.code) if stop < 0 else stop
            line = s.code[at:stop]
            # Lines inside brackets or strings that begin earlier belong to the statement above.
            inner = at in self.long_strings
            if line.strip() or inner:
                if not inner and len(line) - len(line.lstrip()) <= indent and not self.in_brackets(at):
                    break
                last = stop
            at = stop + 1
        return last

    def in_brackets(self, at: int) -> bool:
        return at in self.brackets

    def docstring(self, colon: int, end: int) -> str | None:
        i = bisect.bisect_right(self.string_starts, colon)
        hit = self.s.strings[i] if i < len(self.s.strings) else None
        if hit and hit[0] < end and self.s.code[colon + 1 : hit[0]].strip() == "":
            return self.s.text[hit[0] : hit[1]].lstrip("rRbBuUfF").strip("\"'").strip() or None
        return None

    def sig(self, at: int, colon: int) -> dict:
        s = self.s
        i = s.code.find("(", at)
        if i < 0:
            return signature([], None)
        params = []
        for p in split_top(self.slice(i + 1, s.end_of(i) - 1), angles=False):
            m = re.match(r"(\w+)\s*(?::\s*([^=]+?))?\s*(?:=.*)?$", p, re.S)
            if m and m[1] not in ("self", "cls"):
                params.append((m[1], m[2].strip() if m[2] else None))
        m = re.match(r"\s*->\s*(.*)", self.slice(s.end_of(i), colon), re.S)
        return signature(params, m[1].strip() if m else None)

    def literal_end(self, at: int) -> int:
        """Where the literal that begins at ``at`` and fills its line ends; 0 if there is none."""
        s = self.s
        i = bisect.bisect_left(self.string_starts, at)
        string = s.strings[i][1] if i < len(s.strings) and s.strings[i][0] == at else 0
        m = None if string else LITERAL.match(self.ended, at)
        end = string or (m.end() if m else 0)
        return end if end and s.code[end : self.ended.find("\n", end)].strip(" ;\t") == "" else 0

    def marks(self, at: int) -> list[str]:
        """The decorators directly above ``at``, the nearest first."""
        text, found = self.s.text, []
        while at > 0 and text[at - 1].isspace():
            at -= 1
        while at > 0:
            start = text.rfind("\n", 0, at) + 1
            line = text[start:at]
            if not line.strip().startswith("@"):
                break
            found.append(line)
            at = start - 1
        return found

    def declare(self) -> None:
        s = self.s
        stack: list[tuple[int, str, str, int]] = []  # indent, kind, name, end
        bodies = []
        for m in self.HEAD.finditer(s.code):
            if self.in_brackets(m.start(4)) or m.start(4) in self.within_strings:
                continue
            indent, name, at = len(m[1]), m[4], m.start() + len(m[1])
            end = self.block_end(at, indent)
            stack = [x for x in stack if x[3] > at and x[0] < indent]
            cls = next((x[2] for x in reversed(stack) if x[1] == "class"), "_")
            colon = s.find(":", m.end() if s.code[m.end() : m.end() + 1] != "(" else s.end_of(m.end()))
            colon = end if colon < 0 else colon
            doc = self.docstring(colon, end)
            if m[3]:
                self.add("class", "_", (name, m.start(4)), at, end, description=doc)
                i = m.end()
                if s.code[i : i + 1] == "(":
                    for base in split_top(s.code[i + 1 : s.end_of(i) - 1], angles=False):
                        if re.fullmatch(r"[\w.]+", base):
                            self.refs.append(Ref("inherits_from", "_", name, base.split(".")[-1], i))
            else:
                mark = "overload" if any("overload" in x for x in self.marks(at)) else ""
                self.add("function", cls, (name, m.start(4)), at, end, description=doc, signatures=[self.sig(m.end(), colon)], mark=mark)
                self.spans.append((colon, end, "_" if self.compat else cls, name))
            stack.append((indent, "class" if m[3] else "def", name, end))
            bodies.append((at, end, bool(m[3])))
        inside = Cover((a, b) for a, b, is_class in bodies if is_class or not self.compat)  # Q21
        for m in self.CONST.finditer(s.code):
            if m.start(2) not in inside and not self.in_brackets(m.start(2)) and m.start(2) not in self.within_strings and (stop := self.literal_end(m.start(3))):
                self.add("constant", "_", (m[2], m.start(2)), m.start(2), stop)


class JavaScript(Extractor):
    """O-38"""

    language = "javascript"
    FUNCTION = re.compile(r"(?:\basync\s+)?\bfunction\b\s*\*?\s*(\w+)\s*(?=[<(])")
    CLASS = re.compile(r"(?:\babstract\s+)?\b(class|interface)\s+(\w+)")
    METHOD = re.compile(r"(?:\b(?:public|private|protected|static|async|get|set|readonly|override)\s+|\*\s*)*(#?[\w$]+)\s*(?=[<(])")
    VALUE = re.compile(r"\b(const|let|var)\s+([\w$]+)\s*(?::[^=;\n]+)?=(?!=)\s*")

    def first_doc(self) -> list[tuple[int, int]]:
        if not hasattr(self, "_first_doc"):
            self._first_doc = [c for c in self.s.comments if self.s.text.startswith("/**", c[0])][:1]
        return self._first_doc

    def doc(self, at: int) -> str | None:
        if self.compat:  # Q25, Q26: the first one of the parent
            found = [self.s.text[a:b] for a, b in self.first_doc() if b <= at]
        else:
            found = self.s.comments_above(at, lambda c: c.startswith("/**"), skip=r"@\w")[-1:]
        lines = [re.sub(r"^\s*\*+ ?", "", x).strip() for c in found for x in c[3:].removesuffix("*/").split("\n")]
        return " ".join(x for x in lines if x) or None

    def sig(self, opener: int, stop: int) -> dict:
        s, params = self.s, []
        for p in split_top(self.slice(opener + 1, s.end_of(opener) - 1)):
            p = re.sub(r"^(?:(?:public|private|protected|readonly)\s+)+", "", p)
            m = re.match(r"([\w$]+)\s*\??\s*(?::\s*([^=]+?))?\s*(?:=.*)?$", p, re.S)
            if m:
                params.append((m[1], m[2].strip() if m[2] else None))
        m = re.match(r"\s*:\s*(.*)", self.slice(s.end_of(opener), stop), re.S)
        return signature(params, m[1].strip() if m else None)

    def round(self, at: int) -> int:
        """The round bracket at or behind type parameters."""
        i = at
        while i < len(self.s.code) and self.s.code[i] != "(":
            i += 1
        return i

    def declare(self) -> None:
        s = self.s
        classes = []
        for m in self.CLASS.finditer(s.code):
            body = s.code.find("{", m.end())
            if body < 0:
                continue
            end = s.end_of(body)
            classes.append((body, end, m[2], m[1]))
            self.add("class", "_", (m[2], m.start(2)), m.start(), end, description=self.doc(m.start()))
            head = s.code[m.end() : body]
            for word, kind in (("extends", "inherits_from"), ("implements", "implements")):
                c = re.search(rf"\b{word}\b(.*?)(?=\bextends\b|\bimplements\b|$)", head, re.S)
                for base in split_top(c[1]) if c else ():
                    if b := re.match(r"[\w$.]+", base):
                        self.refs.append(Ref(kind, "_", m[2], b.group().split(".")[-1], m.end()))
        def owners():
            """The class of a position, for positions in ascending order."""
            found = Innermost((a + 1, b, cls) for a, b, cls, _ in classes)
            return lambda at: (found.at(at) or ("_",))[-1]

        owner = owners()
        for m in self.FUNCTION.finditer(s.code):
            i = self.round(m.end())
            body = s.find("{;", s.end_of(i))
            if body < 0 or s.code[body] == ";":
                continue
            end = s.end_of(body)
            cls = owner(m.start())
            self.add("function", cls, (m[1], m.start(1)), m.start(), end, description=self.doc(m.start()), signatures=[self.sig(i, body)])
            self.spans.append((body, end, "_" if self.compat else cls, m[1]))
        for body, end, cls, kind in classes:
            at, m, brace = body + 1, *NOT_LOOKED
            while kind == "class" and at < end - 1:
                m, brace = self.next_method(m, brace, at, end - 1)
                if brace >= 0 and (not m or brace < m.start(1)):
                    at = s.end_of(brace)
                    continue
                if not m:
                    break
                i = self.round(m.end())
                after = s.end_of(i)
                stop = re.compile(r"\s*(?::\s*[^;{=\n]+)?\s*(?=\{)").match(s.code, after)
                line = s.code[s.line_start(m.start(1)) : m.start(1)]
                if stop and m[1] not in NOT_CALLS and "=" not in line and "." not in line:
                    stop_at = s.code.find("{", stop.end())
                    done = s.end_of(stop_at)
                    self.add("function", cls, (m[1], m.start(1)), m.start(), done, description=self.doc(m.start()), signatures=[self.sig(i, stop_at)])
                    self.spans.append((stop_at, done, "_" if self.compat else cls, m[1]))
                    at = done
                else:
                    at = after
        owner = owners()
        for m in self.VALUE.finditer(s.code):
            at = m.end()
            arrow = re.compile(r"(?:async\s*)?(?:function\b\s*\*?\s*)?").match(s.code, at)
            i = arrow.end()
            cls = owner(m.start())
            end = None
            if s.code[i : i + 1] == "(":
                tail = re.compile(r"\s*(?::\s*[^={;]+)?\s*=>\s*").match(s.code, s.end_of(i))
                stop = tail.end() if tail else s.find("{", s.end_of(i)) if "function" in arrow.group() else -1
                if stop >= 0:
                    sig = self.sig(i, s.code.rfind("=>", 0, stop) if tail else stop)
                    end = s.end_of(stop) if s.code[stop : stop + 1] == "{" else (s.find(";\n", stop) if s.find(";\n", stop) >= 0 else len(s.code))
            elif one := re.compile(r"([\w$]+)\s*=>\s*").match(s.code, i):
                stop, sig = one.end(), signature([(one[1], None)], None)
                end = s.end_of(stop) if s.code[stop : stop + 1] == "{" else (s.find(";\n", stop) if s.find(";\n", stop) >= 0 else len(s.code))
            if end is not None:
                self.add("function", cls, (m[2], m.start(2)), at, end, description=self.doc(m.start()), signatures=[sig])
                self.spans.append((at, end, "_" if self.compat else cls, m[2]))
            elif cls == "_" and (LITERAL.match(s.code, at) or s.text[at : at + 1] == "`"):
                stop = s.code.find("\n", at)
                self.add("constant", "_", (m[2], m.start(2)), m.start(), len(s.code) if stop < 0 else stop, description=self.doc(m.start()))


class TypeScript(JavaScript):
    language = "typescript"


class Go(Extractor):
    """O-39"""

    language = "go"
    FUNC = re.compile(r"(?m)^func\s*(?:\(([^)]*)\)\s*)?(\w+)\s*(?=[(\[])")
    TYPE = re.compile(r"(?m)^type\s+(\w+)[^\n=]*?\b(?:struct|interface)\b\s*\{")
    CONST = re.compile(r"(?m)\bconst\s+(\w+)")

    def doc(self, at: int) -> str | None:
        if self.compat:
            found = [self.s.text[a:b] for a, b in self.s.comments if b <= at]
        else:
            found = self.s.comments_above(at, lambda c: True)
        return " ".join(re.sub(r"^//|^/\*|\*/$", "", c).strip() for c in found) or None

    def params(self, text: str) -> list[tuple[str, str | None]]:
        out, waiting = [], []
        for p in split_top(text):
            m = re.match(r"(\w+)\s+(.+)$", p, re.S)
            if m:
                out += [(n, m[2].strip()) for n in [*waiting, m[1]]]
                waiting = []
            else:
                waiting.append(p)
        return out

    def declare(self) -> None:
        s = self.s
        for m in self.FUNC.finditer(s.code):
            i = s.code.find("(", m.end())
            if i < 0:
                continue
            body = s.find("{\n", s.end_of(i))
            if body < 0 or s.code[body] == "\n":
                continue
            end = s.end_of(body)
            cls = re.sub(r"\[.*", "", (m[1] or "").split()[-1].lstrip("*")) if (m[1] or "").split() else "_"
            returns = self.slice(s.end_of(i), body).strip() or None
            self.add("function", cls, (m[2], m.start(2)), m.start(), end, description=self.doc(m.start()), signatures=[signature(self.params(self.slice(i + 1, s.end_of(i) - 1)), returns)])
            self.spans.append((body, end, cls, m[2]))
        for m in self.TYPE.finditer(s.code):
            self.add("class", "_", (m[1], m.start(1)), m.start(), s.end_of(m.end() - 1), description=self.doc(m.start()))
        for m in re.finditer(r"(?m)^type\s*\(", s.code):
            end = s.end_of(m.end() - 1)
            for t in re.compile(r"(?m)^\s*(\w+)[^\n=]*?\b(?:struct|interface)\b\s*\{").finditer(s.code, m.end(), end):
                self.add("class", "_", (t[1], t.start(1)), t.start(1), s.end_of(t.end() - 1), description=self.doc(t.start(1)))
        for m in self.CONST.finditer(s.code):
            stop = s.code.find("\n", m.end())
            self.add("constant", "_", (m[1], m.start(1)), m.start(), len(s.code) if stop < 0 else stop, description=self.doc(m.start()))
        for m in re.finditer(r"(?m)\bconst\s*\(", s.code):
            end = s.end_of(m.end() - 1)
            for c in re.compile(r"(?m)^\s*(\w+)(?=[\s,=]|$)[^\n]*").finditer(s.code, m.end(), end - 1):  # Q27: the first name of each
                self.add("constant", "_", (c[1], c.start(1)), c.start(1), c.end(), description=self.doc(c.start(1)))


class Java(Extractor):
    """O-40"""

    language = "java"
    TYPE = re.compile(r"(?:\b(?:public|private|protected|static|final|abstract|sealed|strictfp)\s+)*\b(class|interface|enum)\s+(\w+)")
    METHOD = re.compile(r"((?:@\w+(?:\([^)]*\))?\s+|\b(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*)(?:<[^>{;]*>\s*)?(?:([\w.]+(?:<[^;{}()]*>)?(?:\[\])*)\s+)?(\w+)\s*(?=\()")

    def doc(self, at: int) -> str | None:
        found = self.s.comments_above(at, lambda c: True, skip=r"@\w")
        lines = [re.sub(r"^\s*(?:/\*\*?|\*/|//|\*(?!/))\s?", "", x).removesuffix("*/").strip() for c in found for x in c.split("\n")]
        return " ".join(x for x in lines if x) or None

    def declare(self) -> None:
        s = self.s
        types = []
        for m in self.TYPE.finditer(s.code):
            body = s.code.find("{", m.end())
            if body < 0:
                continue
            types.append((body, s.end_of(body), m[2]))
            self.add("class", "_", (m[2], m.start(2)), m.start(), s.end_of(body), description=self.doc(m.start()))
        for body, end, cls in types:
            at, m, brace = body + 1, *NOT_LOOKED
            while at < end - 1:
                m, brace = self.next_method(m, brace, at, end - 1)
                if brace >= 0 and (not m or brace < m.start(3)):
                    at = s.end_of(brace)
                    continue
                if not m:
                    break
                after = s.end_of(m.end() if s.code[m.end()] == "(" else s.code.find("(", m.end()))
                tail = re.compile(r"\s*(?:throws\s+[\w.,\s]+)?\s*([{;])").match(s.code, after)
                line = s.code[s.line_start(m.start(3)) : m.start(3)]
                if not tail or m[3] in NOT_CALLS or "=" in line or not (m[2] or m[3] == cls) or m[2] in ("new", "return", "throw", "else"):
                    at = after
                    continue
                stop = tail.end() - 1
                done = s.end_of(stop) if s.code[stop] == "{" else stop + 1
                params = []
                for p in split_top(self.slice(s.code.find("(", m.start(3)) + 1, after - 1)):
                    p = re.sub(r"^(?:(?:final|@\w+(?:\([^)]*\))?)\s+)+", "", p)
                    kind, _, name = p.rpartition(" ")
                    params.append((name.strip(), kind.strip() or None))
                self.add("function", cls, (m[3], m.start(3)), m.start(), done, description=self.doc(m.start()), signatures=[signature(params, m[2] if m[2] else None)])
                if s.code[stop] == "{":
                    self.spans.append((stop, done, cls, m[3]))
                at = done


#: O-44: language -> extractor; users may register their own.
EXTRACTORS: dict[str, type[Extractor]] = {"rust": Rust, "python": Python, "javascript": JavaScript, "typescript": TypeScript, "go": Go, "java": Java}


def collapse(symbols: list[Symbol], language: str, compat: bool) -> list[Symbol]:
    """O-41, O-42: overloads become one symbol with all signatures. Without ``compat`` a class keeps its methods apart (Q23)."""
    if language == "python":
        key = lambda x: (x.kind, x.cls if not compat else "", x.name) if x.mark else None
    elif language in ("typescript", "javascript"):
        key = lambda x: (x.kind, x.cls if not compat else "", x.name)
    else:
        return symbols
    first: dict = {}
    out = []
    for x in symbols:
        k = key(x)
        if k is not None and k in first:
            first[k].signatures = first[k].signatures + x.signatures
            first[k].mark = ""
        else:
            if k is not None:
                first[k] = x
            out.append(x)
    return out


def python_imports(text: str) -> list[tuple[str, str]]:
    """O-49: (name in the file, module or symbol it stands for) of top-level imports."""
    code, out = Source(text, "python").code, []
    for m in re.finditer(r"(?m)^(?:from[ \t]+([\w.]+)[ \t]+)?import[ \t]+(\([^)]*\)|[^\n;]+)", code):
        for part in split_top(m[2].strip("() \t\r\n").replace("\n", " "), angles=False):
            name, _, alias = (x.strip() for x in part.partition(" as "))
            if not re.fullmatch(r"[\w.]+", name):
                continue
            whole = f"{m[1]}.{name}" if m[1] else name
            out.append((alias or (name if m[1] else name.split(".")[-1]), whole))
    return out


def extract(path: str, language: str, text: str, compat: bool = False) -> tuple[list[dict], list[dict]]:
    """(symbols, references) of a file; a language without an extractor, or text it cannot read, gives none."""
    if language not in EXTRACTORS:
        return [], []
    x = EXTRACTORS[language](text, compat).run()
    directory, _, file = path.rpartition("/")
    directory = directory or "."
    ident = lambda cls, symbol: build_node_id(directory, file, cls, symbol)
    symbols = sorted(x.symbols, key=lambda y: (y.start, y.cls == "_"))
    nodes = []
    for i, y in enumerate(collapse(symbols, language, compat)):
        digest = hashlib.sha256(text[y.start : y.end].encode("utf-8", "surrogatepass")).hexdigest()
        nodes.append(
            {
                "node_id": ident(y.cls, y.name), "kind": y.kind, "name": y.name, "description": y.description, "signatures": y.signatures, "language": language, "file_path": path,
                "start_line": x.s.line(y.start), "end_line": x.s.line(max(y.start, y.end - 1)), "content_hash": ("overload:" if y.mark else "") + digest, "git_sha": None, "renamed_from": None, "seq": i,
            }
        )
    refs = [{"kind": r.kind, "from_id": ident(r.cls, r.symbol), "ref_name": r.name, "language": language, "file_path": path, "seq": i} for i, r in enumerate(x.refs) if r.name]
    return nodes, refs
