"""A syntax tree of JavaScript and TypeScript sources: tokens by one pattern, statements by descent, expressions by binding power.

Types are read as names only. What the grammar here doesn't know raises SyntaxError, and callers fall back.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

#: Longest first.
PUNCTUATION = [">>>=", "...", "===", "!==", "**=", "<<=", ">>=", ">>>", "&&=", "||=", "??=", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>", "**", *"{}()[];,<>+-*/%&|^!~?:=.@#"]
ASSIGNS = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
#: Binding power of binary operators.
POWER = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
PREFIX = {"!", "~", "+", "-", "++", "--", "typeof", "void", "delete", "await"}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "get", "set", "accessor"}
#: Words after which a slash begins a regular expression.
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "else", "do", "yield", "await"}
SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)+", re.S)
TOKEN = re.compile(
    r"(?P<name>[A-Za-z_$ª-￿][\w$ª-￿]*)|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<punct>" + "|".join(map(re.escape, PUNCTUATION)) + ")",
    re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")


class Node:
    """A node: type, [start, end) in the text, children in order, and some of them by field name."""

    __slots__ = ("type", "start", "end", "children", "fields", "named")

    def __init__(self, kind: str, start: int, end: int, children: list[Node] | None = None, named: bool = True, **fields: Node | None):
        self.type, self.start, self.end, self.named = kind, start, end, named
        self.children, self.fields = children or [], {k: v for k, v in fields.items() if v is not None}

    def walk(self) -> Iterator[Node]:
        """This node and all below, parents first."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def kids(self) -> list[Node]:
        return [c for c in self.children if c.named]


class Source:
    """A text with its lines."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, n: Node) -> str:
        return self.text[n.start : n.end]

    def place(self, at: int) -> tuple[int, int]:
        """Line and column, from 1."""
        line = bisect.bisect_right(self.lines, at)
        return line, at - self.lines[line - 1] + 1


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end); kinds: name, number, string, template, regex, or the punctuation itself."""
    out: list[tuple[str, int, int]] = []
    at = 0
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else len(text)
    while True:
        if m := SPACE.match(text, at):
            at = m.end()
        if at >= len(text):
            return out
        c = text[at]
        if c == "`":
            end = _template(text, at)
            out.append(("template", at, end))
            at = end
            continue
        if c == "/" and _regex_may_follow(out, text) and (m := REGEX.match(text, at)):
            out.append(("regex", at, m.end()))
            at = m.end()
            continue
        m = TOKEN.match(text, at)
        if m is None:
            raise SyntaxError(f"character {c!r} at {at}")
        out.append((m[0] if m.lastgroup == "punct" else m.lastgroup, at, m.end()))
        at = m.end()


def _regex_may_follow(out: list[tuple[str, int, int]], text: str) -> bool:
    if not out:
        return True
    kind, a, b = out[-1]
    if kind == "name":
        return text[a:b] in BEFORE_REGEX
    return kind not in ("number", "string", "template", "regex", ")", "]", "}", "++", "--")


def _template(text: str, at: int) -> int:
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = _template(text, at)
                    continue
                depth += {"{": 1, "}": -1}.get(text[at], 0)
                at += 1
        else:
            at += 1
    raise SyntaxError("template without an end")


class Parser:
    """One text's tokens and a place among them."""

    def __init__(self, text: str, toks: list[tuple[str, int, int]] | None = None):
        self.text, self.toks, self.at = text, tokens(text) if toks is None else toks, 0

    # -- tokens

    def word(self, ahead: int = 0) -> str:
        """The token's text, or '' past the end."""
        k = self.at + ahead
        return self.text[self.toks[k][1] : self.toks[k][2]] if k < len(self.toks) else ""

    def kind(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.toks[k][0] if k < len(self.toks) else ""

    def begin(self) -> int:
        return self.toks[self.at][1] if self.at < len(self.toks) else len(self.text)

    def end(self) -> int:
        return self.toks[self.at - 1][2] if self.at else 0

    def leaf(self, kind: str | None = None, named: bool | None = None) -> Node:
        if self.at >= len(self.toks):
            raise SyntaxError("unexpected end")
        k, a, b = self.toks[self.at]
        self.at += 1
        return Node(kind or self.text[a:b], a, b, named=kind is not None if named is None else named)

    def take(self, *words: str) -> Node | None:
        return self.leaf() if self.kind() not in ("string", "template", "regex") and self.word() in words and self.at < len(self.toks) else None

    def need(self, word: str) -> Node:
        got = self.take(word)
        if got is None:
            raise SyntaxError(f"{word} expected at {self.begin()}, found {self.word()!r}")
        return got

    def new_line(self) -> bool:
        return self.at < len(self.toks) and "\n" in self.text[self.end() : self.begin()]

    def node(self, kind: str, children: list[Node | None], **fields: Node | None) -> Node:
        kids = [c for c in children if c is not None]
        return Node(kind, kids[0].start, kids[-1].end, kids, **fields)

    def close(self) -> Node | None:
        """The end of a statement: a semicolon, or a line's or block's end."""
        got = self.take(";")
        if got is None and self.word() not in ("}", "") and not self.new_line() and self.word() not in (")",):
            raise SyntaxError(f"end of a statement expected at {self.begin()}, found {self.word()!r}")
        return got

    # -- statements

    def program(self) -> Node:
        kids = []
        while self.at < len(self.toks):
            kids.append(self.statement())
        return Node("program", 0, len(self.text), kids)

    def block(self) -> Node:
        kids = [self.need("{")]
        while self.word() != "}":
            kids.append(self.statement())
        return self.node("statement_block", [*kids, self.need("}")])

    def paren(self) -> Node:
        return self.node("parenthesized_expression", [self.need("("), self.sequence(), self.need(")")])

    def statement(self) -> Node:
        if self.kind() in ("name", "{", ";", "@"):
            rule = getattr(self, f"_{self.word()}", None) if self.kind() == "name" else None
            if rule is not None and self.word(1) not in (".", "=", ":", "=>", ")", ",") and not (self.word(1) == "(" and self.word() in ("type", "import", "abstract", "declare", "enum", "namespace", "module", "interface", "async")):
                return rule()
            if self.word() == "{":
                return self.block()
            if self.word() == ";":
                return self.node("empty_statement", [self.need(";")])
            if self.word() == "@":
                decorator = self.decorators()
                got = self.statement()
                return Node(got.type, decorator[0].start, got.end, [*decorator, *got.children], **got.fields)
            if self.kind() == "name" and self.word(1) == ":" and self.word() not in ("default", "case"):
                label, colon = self.leaf("statement_identifier"), self.need(":")
                return self.node("labeled_statement", [label, colon, self.statement()])
        value = self.sequence()
        return self.node("expression_statement", [value, self.close()])

    def decorators(self) -> list[Node]:
        out = []
        while self.word() == "@":
            out.append(self.node("decorator", [self.need("@"), self.postfix()]))
        return out

    def _if(self) -> Node:
        word, test, then = self.need("if"), self.paren(), self.statement()
        other = None
        if self.word() == "else":
            other = self.node("else_clause", [self.need("else"), self.statement()])
        return self.node("if_statement", [word, test, then, other], condition=test, consequence=then, alternative=other)

    def _while(self) -> Node:
        word, test, body = self.need("while"), self.paren(), self.statement()
        return self.node("while_statement", [word, test, body], condition=test, body=body)

    def _do(self) -> Node:
        word, body, again, test = self.need("do"), self.statement(), self.need("while"), self.paren()
        return self.node("do_statement", [word, body, again, test, self.take(";")], condition=test, body=body)

    def _for(self) -> Node:
        kids: list[Node | None] = [self.need("for"), self.take("await"), self.need("(")]
        kind, left = "for_statement", None
        if self.word() in ("const", "let", "var"):
            word = self.leaf()
            declared = [self.declarator()]
            while comma := self.take(","):
                declared += [comma, self.declarator()]
            if self.word() in ("of", "in"):  # the loop itself declares the name
                kids.append(word)
                left = declared[0].fields["name"]
            else:
                left = self.node("variable_declaration" if self.text[word.start : word.end] == "var" else "lexical_declaration", [word, *declared])
        elif self.word() != ";":
            left = self.sequence(no_in=True)
        kids.append(left)
        if word := self.take("of", "in"):
            kind, right = "for_in_statement", self.sequence()
            kids += [word, right]
        else:
            kids += [self.need(";"), None if self.word() == ";" else self.sequence(), self.need(";"), None if self.word() == ")" else self.sequence()]
        kids.append(self.need(")"))
        body = self.statement()
        return self.node(kind, [*kids, body], body=body)

    def _switch(self) -> Node:
        word, test, kids = self.need("switch"), self.paren(), [self.need("{")]
        while self.word() != "}":
            if self.word() == "default":
                case: list[Node] = [self.need("default"), self.need(":")]
            else:
                case = [self.need("case"), self.sequence(), self.need(":")]
            heads = len(case)
            while self.word() not in ("case", "default", "}"):
                case.append(self.statement())
            kids.append(self.node("switch_default" if heads == 2 else "switch_case", case))
        body = self.node("switch_body", [*kids, self.need("}")])
        return self.node("switch_statement", [word, test, body], body=body)

    def _try(self) -> Node:
        word, body, handler, final = self.need("try"), self.block(), None, None
        if self.word() == "catch":
            kids = [self.need("catch")]
            if self.word() == "(":
                kids += [self.need("("), self.pattern(), self.annotation(), self.need(")")]
            inner = self.block()
            handler = self.node("catch_clause", [*kids, inner], body=inner)
        if self.word() == "finally":
            kids, inner = [self.need("finally")], self.block()
            final = self.node("finally_clause", [*kids, inner], body=inner)
        return self.node("try_statement", [word, body, handler, final], body=body, handler=handler, finalizer=final)

    def _jump(self, kind: str, value: bool) -> Node:
        kids: list[Node | None] = [self.leaf()]
        if self.word() not in (";", "}", "") and not self.new_line():
            kids.append(self.sequence() if value else self.leaf("statement_identifier"))
        return self.node(kind, [*kids, self.close()])

    def _return(self) -> Node:
        return self._jump("return_statement", True)

    def _throw(self) -> Node:
        return self._jump("throw_statement", True)

    def _break(self) -> Node:
        return self._jump("break_statement", False)

    def _continue(self) -> Node:
        return self._jump("continue_statement", False)

    def _debugger(self) -> Node:
        return self._jump("debugger_statement", False)

    def _var(self) -> Node:
        kind = "variable_declaration" if self.word() == "var" else "lexical_declaration"
        if self.word() == "const" and self.word(1) == "enum":
            return self.node("enum_declaration", [self.leaf(), *self._enum().children])
        kids = [self.leaf(), self.declarator()]
        while comma := self.take(","):
            kids += [comma, self.declarator()]
        return self.node(kind, [*kids, self.close()])

    _let = _const = _var

    def declarator(self) -> Node:
        name = self.pattern()
        kids: list[Node | None] = [name, self.take("!"), self.annotation()]
        value = None
        if equals := self.take("="):
            value = self.expression()
            kids += [equals, value]
        return self.node("variable_declarator", kids, name=name, value=value)

    def pattern(self) -> Node:
        """A binding: a name, or an object or array of bindings."""
        return self.primary() if self.word() in ("{", "[") else self.leaf("identifier")

    def _function(self) -> Node:
        return self.function("function_declaration")

    def _async(self) -> Node:
        if self.word(1) == "function":
            return self.function("function_declaration")
        return self.node("expression_statement", [self.sequence(), self.close()])

    def function(self, kind: str) -> Node:
        kids: list[Node | None] = [self.take("async"), self.need("function"), self.take("*")]
        name = self.leaf("identifier") if self.kind() == "name" else None
        return self._rest(kind, [*kids, name], name)

    def _rest(self, kind: str, kids: list[Node | None], name: Node | None) -> Node:
        """Type parameters, parameters, result type and body of a function."""
        params = None
        kids += [self.type_parameters(), params := self.parameters(), self.annotation()]
        body = self.block() if self.word() == "{" else None
        kids.append(body or self.close())
        return self.node(kind, kids, name=name, parameters=params, body=body)

    def parameters(self) -> Node:
        kids: list[Node | None] = [self.need("(")]
        while self.word() != ")":
            own: list[Node | None] = list(self.decorators())
            while self.word() in MODIFIERS and self.kind(1) == "name":
                own.append(self.leaf())
            own.append(self.take("..."))
            name = self.pattern()
            own += [name, self.take("?"), self.annotation()]
            if equals := self.take("="):
                own += [equals, self.expression()]
            kids += [self.node("required_parameter", own, name=name), self.take(",")]
        return self.node("formal_parameters", [*kids, self.need(")")])

    def _class(self) -> Node:
        return self.class_("class_declaration")

    def _abstract(self) -> Node:
        word = self.need("abstract")
        got = self.class_("class_declaration")
        return Node(got.type, word.start, got.end, [word, *got.children], **got.fields)

    def class_(self, kind: str) -> Node:
        kids: list[Node | None] = [self.need("class")]
        name = self.leaf("type_identifier") if self.kind() == "name" and self.word() not in ("extends", "implements") else None
        kids += [name, self.type_parameters()]
        heritage = []
        while self.word() in ("extends", "implements"):
            word = self.leaf()
            heritage.append(self.node(f"{self.text[word.start : word.end]}_clause", [word, self.types("{", "implements")]))
        body = self.class_body()
        return self.node(kind, [*kids, *heritage, body], name=name, body=body)

    def class_body(self) -> Node:
        kids: list[Node] = [self.need("{")]
        while self.word() != "}":
            if semi := self.take(";"):
                kids.append(semi)
                continue
            kids.append(self.member())
        return self.node("class_body", [*kids, self.need("}")])

    def member(self) -> Node:
        own: list[Node | None] = list(self.decorators())
        while self.word() in MODIFIERS and self.word(1) not in ("(", "=", ";", ":", "?", "}", ",", "<"):
            own.append(self.leaf())
            if self.word() == "{":
                inner = self.block()
                return self.node("class_static_block", [*own, inner], body=inner)
        own += [self.take("*"), self.take("#")]
        if self.word() == "[":
            name = self.node("computed_property_name", [self.need("["), self.types("]"), self.need("]")])
        else:
            name = self.leaf({"string": "string", "number": "number"}.get(self.kind(), "property_identifier"))
        own += [name, self.take("?", "!")]
        if self.word() in ("(", "<"):
            return self._rest("method_definition", own, name)
        own.append(self.annotation())
        value = None
        if equals := self.take("="):
            value = self.expression()
            own += [equals, value]
        return self.node("public_field_definition", [*own, self.take(";", ",")], name=name, value=value)

    def _interface(self) -> Node:
        kids: list[Node | None] = [self.need("interface")]
        name = self.leaf("type_identifier")
        kids += [name, self.type_parameters()]
        if word := self.take("extends"):
            kids.append(self.node("extends_clause", [word, self.types("{")]))
        body = self.balanced("interface_body")
        return self.node("interface_declaration", [*kids, body], name=name, body=body)

    def _type(self) -> Node:
        kids: list[Node | None] = [self.need("type")]
        name = self.leaf("type_identifier")
        kids += [name, self.type_parameters(), self.need("="), self.types(";", lines=True)]
        return self.node("type_alias_declaration", [*kids, self.take(";")], name=name)

    def _enum(self) -> Node:
        word, name = self.need("enum"), self.leaf("identifier")
        return self.node("enum_declaration", [word, name, self.balanced("enum_body")], name=name)

    def _namespace(self) -> Node:
        word, name = self.leaf(), self.types("{")
        body = self.block()
        return self.node("module", [word, name, body], name=name, body=body)

    _module = _namespace

    def _declare(self) -> Node:
        word, got = self.need("declare"), self.statement()
        return self.node("ambient_declaration", [word, got], declaration=got)

    def _import(self) -> Node:
        if self.word(1) in ("(", "."):
            return self.node("expression_statement", [self.sequence(), self.close()])
        kids: list[Node | None] = [self.need("import")]
        if self.word() == "type" and self.word(1) not in ("from", ","):
            kids.append(self.leaf())
        clause = None
        if self.kind() != "string":
            own: list[Node | None] = []
            while self.word() != "from":
                if self.kind() == "name":
                    own.append(self.leaf("identifier"))
                elif self.word() == "*":
                    own.append(self.node("namespace_import", [self.need("*"), self.need("as"), self.leaf("identifier")]))
                elif self.word() == "{":
                    own.append(self.specifiers("named_imports", "import_specifier"))
                else:
                    own.append(self.need(","))
            clause = self.node("import_clause", own)
            kids += [clause, self.need("from")]
        source = self.leaf("string")
        kids.append(source)
        if self.word() in ("with", "assert") and not self.new_line():
            kids += [self.leaf(), self.balanced("import_attributes")]
        return self.node("import_statement", [*kids, self.close()], clause=clause, source=source)

    def specifiers(self, kind: str, one: str) -> Node:
        kids: list[Node | None] = [self.need("{")]
        while self.word() != "}":
            mark = self.leaf() if self.word() == "type" and self.kind(1) == "name" and self.word(1) != "as" else None
            name, alias, word = self.leaf("string" if self.kind() == "string" else "identifier"), None, None
            if word := self.take("as"):
                alias = self.leaf("identifier")
            kids += [self.node(one, [mark, name, word, alias], name=name, alias=alias), self.take(",")]
        return self.node(kind, [*kids, self.need("}")])

    def _export(self) -> Node:
        kids: list[Node | None] = [self.need("export"), self.take("default")]
        if self.word() == "type" and self.word(1) in ("{", "*"):
            kids.append(self.leaf())
        declared = source = None
        if self.word() == "{":
            declared = self.specifiers("export_clause", "export_specifier")
        elif self.word() == "*":
            kids.append(self.need("*"))
            if word := self.take("as"):
                kids += [word, self.leaf("identifier")]
        elif word := self.take("="):
            declared = self.sequence()
            kids.append(word)
        elif kids[-1] is not None and kids[-1].type == "default" and self.word() not in ("function", "class", "abstract", "interface") and not (self.word() == "async" and self.word(1) == "function"):
            declared = self.expression()
        else:
            declared = self.statement()
            return self.node("export_statement", [*kids, declared], declaration=declared)
        kids.append(declared)
        if word := self.take("from"):
            source = self.leaf("string")
            kids += [word, source]
        return self.node("export_statement", [*kids, self.close()], declaration=declared, source=source)

    # -- types, read as names

    def annotation(self) -> Node | None:
        if self.word() != ":":
            return None
        colon = self.need(":")
        inner = self.types(",", ")", "=", ";", "{", "}", "=>", "]", lines=True, object_first=True)
        return self.node("type_annotation", [colon, inner])

    def type_parameters(self) -> Node | None:
        if self.word() != "<":
            return None
        kids, depth = [], 0
        while True:
            word = self.word()
            depth += {"<": 1, ">": -1, ">>": -2, ">>>": -3, "": -99}.get(word, 0)
            kids.append(self._type_leaf())
            if depth <= 0:
                return self.node("type_parameters", kids)

    def _type_leaf(self) -> Node:
        if self.kind() == "name":
            return self.leaf("type_identifier" if self.word() not in ("string", "number", "boolean", "any", "void", "unknown", "never", "null", "undefined", "object", "extends", "keyof", "typeof", "readonly", "is", "in", "infer", "true", "false", "asserts", "unique", "symbol", "bigint", "this") else "predefined_type")
        return self.leaf(self.kind() if self.kind() in ("string", "number", "template") else None)

    def types(self, *stops: str, lines: bool = False, object_first: bool = False) -> Node:
        """Tokens up to one of stops outside of brackets; with lines, also up to a line's end where a type is complete."""
        kids, depth, first = [], 0, True
        while self.at < len(self.toks):
            word, before = self.word(), self.text[kids[-1].start : kids[-1].end] if kids else ""
            if depth == 0:
                if word == "{" and "{" in stops and (not object_first or not first and before not in ("|", "&", "=>", ",", "<", "extends", "?", ":", "is")):
                    break
                if word == "=>" and "=>" in stops and not (kids and before == ")"):
                    break
                if word in stops and word not in ("{", "=>"):
                    break
                if lines and kids and self.new_line() and before not in ("|", "&", "=>", "=", "?", ":", ",", "extends") and word not in ("|", "&", "=>", "?", ":", "."):
                    break
                if word in ("}", ")", "]"):
                    break
            depth += 1 if word in ("(", "[", "{", "<") else -1 if word in (")", "]", "}", ">") else -2 if word == ">>" else -3 if word == ">>>" else 0
            kids.append(self._type_leaf())
            first = False
        if not kids:
            raise SyntaxError(f"type expected at {self.begin()}")
        return self.node("type", kids)

    def balanced(self, kind: str) -> Node:
        """A block of types in braces."""
        kids, depth = [], 0
        while True:
            if self.at >= len(self.toks):
                raise SyntaxError("block without an end")
            depth += {"{": 1, "}": -1}.get(self.word(), 0)
            name = self.kind() == "name" and self.word(1) in (":", "?", "(", ",", "}", "=") and kids and kids[-1].type in ("{", ";", ",", "readonly")
            kids.append(self.leaf("property_identifier") if name else self._type_leaf())
            if depth == 0:
                return self.node(kind, kids)

    # -- expressions

    def sequence(self, no_in: bool = False) -> Node:
        first = self.expression(no_in)
        if self.word() != ",":
            return first
        kids = [first]
        while comma := self.take(","):
            kids += [comma, self.expression(no_in)]
        return self.node("sequence_expression", kids)

    def expression(self, no_in: bool = False) -> Node:
        if arrow := self.arrow():
            return arrow
        if self.word() == "yield":
            kids: list[Node | None] = [self.leaf(), self.take("*")]
            if self.word() not in (")", "]", "}", ",", ";", "") and not self.new_line():
                kids.append(self.expression(no_in))
            return self.node("yield_expression", kids)
        left = self.binary(0, no_in)
        if mark := self.take("?"):
            then, colon, other = self.expression(), self.need(":"), self.expression(no_in)
            return self.node("ternary_expression", [left, mark, then, colon, other], condition=left, consequence=then, alternative=other)
        if self.word() in ASSIGNS and self.kind() == self.word():
            sign = self.leaf()
            right = self.expression(no_in)
            kind = "assignment_expression" if sign.type == "=" else "augmented_assignment_expression"
            return self.node(kind, [left, sign, right], left=left, right=right)
        return left

    def arrow(self) -> Node | None:
        """An arrow function, or None with nothing taken."""
        at = self.at + (self.word() == "async" and not (self.word(1) in ("=>", ",", ")", ".") or self.kind(1) not in ("name", "(", "<")))
        if at < len(self.toks) and self.toks[at][0] == "name" and at + 1 < len(self.toks) and self.toks[at + 1][0] == "=>":
            first = self.leaf() if at > self.at else None
            name = self.leaf("identifier")
            params: Node | None = name
            kids: list[Node | None] = [first, name]
        else:
            if at >= len(self.toks) or self.toks[at][0] not in ("(", "<") or not self._arrow_ahead(at):
                return None
            first = self.leaf() if at > self.at else None
            kids = [first, self.type_parameters()]
            params = self.parameters()
            kids += [params, self.annotation()]
        kids.append(self.need("=>"))
        body = self.block() if self.word() == "{" else self.expression()
        return self.node("arrow_function", [*kids, body], parameters=params, body=body)

    def _arrow_ahead(self, at: int) -> bool:
        depth = 0
        while at < len(self.toks):
            kind = self.toks[at][0]
            depth += 1 if kind in ("(", "[", "{") else -1 if kind in (")", "]", "}") else 0
            at += 1
            if depth == 0 and kind == ")":
                break
        if at >= len(self.toks):
            return False
        if self.toks[at][0] == "=>":
            return True
        if self.toks[at][0] != ":":
            return False
        for k in range(at + 1, min(at + 400, len(self.toks))):
            kind = self.toks[k][0]
            depth += {"(": 1, "[": 1, "{": 1, "<": 1, ")": -1, "]": -1, "}": -1, ">": -1, ">>": -2, ">>>": -3}.get(kind, 0)
            if depth < 0 or depth == 0 and kind in (";", ",", "=", "?", "&&", "||"):
                return False
            if depth == 0 and kind == "=>":
                return True
        return False

    def binary(self, least: int, no_in: bool) -> Node:
        left = self.unary()
        while True:
            word = self.word()
            if word in ("as", "satisfies") and self.kind() == "name" and not self.new_line():
                left = self.node("as_expression", [left, self.leaf(), self.types(")", ",", ";", "]", "}", "=", "?", "&&", "||", "??", "===", "!==", "==", "!=", ":", "+", "-", "*", "/", "%", "instanceof", "in", "as", "=>", lines=True)])
                continue
            power = POWER.get(word, 0) if self.kind() in (word, "name") else 0
            if power <= least or no_in and word == "in":
                return left
            sign = self.leaf()
            right = self.binary(power - (word == "**"), no_in)
            left = self.node("binary_expression", [left, sign, right], left=left, operator=sign, right=right)

    def unary(self) -> Node:
        if self.word() in PREFIX and self.kind() in (self.word(), "name") and not (self.kind() == "name" and self.word(1) in ("=", ".", ")", ",", ";", "=>", ":")):
            sign = self.leaf()
            value = self.unary()
            kind = "await_expression" if sign.type == "await" else "update_expression" if sign.type in ("++", "--") else "unary_expression"
            return self.node(kind, [sign, value])
        if self.word() == "<" and self.kind(1) == "name":  # a cast
            return self.node("type_assertion", [self.type_parameters(), self.unary()])
        value = self.postfix()
        if self.word() in ("++", "--") and not self.new_line():
            return self.node("update_expression", [value, self.leaf()])
        return value

    def postfix(self) -> Node:
        value = self._new_expression() if self.word() == "new" and self.kind() == "name" else self.primary()
        while True:
            word, kind = self.word(), self.kind()
            if kind in (".", "?."):
                sign = self.leaf()
                if self.word() == "(":
                    args = self.arguments()
                    value = self.node("call_expression", [value, sign, args], function=value, arguments=args)
                elif self.word() == "[":
                    value = self.node("subscript_expression", [value, sign, self.need("["), self.sequence(), self.need("]")], object=value)
                else:
                    self.take("#")
                    name = self.leaf("property_identifier")
                    value = self.node("member_expression", [value, sign, name], object=value, property=name)
            elif kind == "(":
                args = self.arguments()
                value = self.node("call_expression", [value, args], function=value, arguments=args)
            elif kind == "[":
                value = self.node("subscript_expression", [value, self.need("["), self.sequence(), self.need("]")], object=value)
            elif kind == "!" and not self.new_line() and self.word(1) not in ("=",):
                value = self.node("non_null_expression", [value, self.leaf()])
            elif kind == "template":
                value = self.node("call_expression", [value, self.leaf("template_string")], function=value)
            elif kind == "<" and self._type_arguments_ahead():
                types = self.type_parameters()
                args = self.arguments()
                value = self.node("call_expression", [value, types, args], function=value, arguments=args)
            else:
                return value

    def _type_arguments_ahead(self) -> bool:
        depth = 0
        for k in range(self.at, min(self.at + 200, len(self.toks))):
            kind = self.toks[k][0]
            depth += {"<": 1, ">": -1, ">>": -2}.get(kind, 0)
            if depth <= 0:
                return k + 1 < len(self.toks) and self.toks[k + 1][0] == "("
            if kind not in ("name", "<", ">", ">>", ",", ".", "[", "]", "|", "&", "string", "{", "}", ":", ";", "?", "(", ")", "=>"):
                return False
        return False

    def arguments(self) -> Node:
        kids: list[Node | None] = [self.need("(")]
        while self.word() != ")" or self.kind() != ")":
            kids += [self.spread(), self.take(",")]
        return self.node("arguments", [*kids, self.need(")")])

    def spread(self) -> Node:
        if dots := self.take("..."):
            return self.node("spread_element", [dots, self.expression()])
        return self.expression()

    def _new_expression(self) -> Node:
        word = self.need("new")
        if self.word() == ".":
            return self.node("meta_property", [word, self.need("."), self.leaf("property_identifier")])
        made = self._new_expression() if self.word() == "new" else self.primary()
        while self.kind() in (".", "["):
            if dot := self.take("."):
                name = self.leaf("property_identifier")
                made = self.node("member_expression", [made, dot, name], object=made, property=name)
            else:
                made = self.node("subscript_expression", [made, self.need("["), self.sequence(), self.need("]")], object=made)
        types = self.type_parameters() if self.word() == "<" and self._type_arguments_ahead() else None
        args = self.arguments() if self.word() == "(" else None
        return self.node("new_expression", [word, made, types, args], constructor=made, arguments=args)

    def primary(self) -> Node:
        kind, word = self.kind(), self.word()
        if kind in ("number", "string", "regex"):
            return self.leaf(kind)
        if kind == "template":
            return self.leaf("template_string")
        if kind == "(":
            return self.paren()
        if kind == "[":
            kids: list[Node | None] = [self.need("[")]
            while self.kind() != "]":
                kids.append(self.take(",") or self.spread())
            return self.node("array", [*kids, self.need("]")])
        if kind == "{":
            return self.object_()
        if kind == "name":
            if word == "function" or word == "async" and self.word(1) == "function":
                return self.function("function_expression")
            if word == "class":
                return self.class_("class")
            if word in ("this", "super", "null", "true", "false", "undefined"):
                return self.leaf(word)
            return self.leaf("identifier")
        if kind == "#":
            return self.node("private_property_identifier", [self.leaf(), self.leaf("identifier")])
        raise SyntaxError(f"expression expected at {self.begin()}, found {word!r}")

    def object_(self) -> Node:
        kids: list[Node | None] = [self.need("{")]
        while self.kind() != "}":
            if self.word() == "...":
                kids.append(self.spread())
            else:
                kids.append(self.pair())
            kids.append(self.take(","))
        return self.node("object", [*kids, self.need("}")])

    def pair(self) -> Node:
        own: list[Node | None] = []
        while self.word() in ("async", "get", "set") and self.kind() == "name" and self.word(1) not in (",", ":", "}", "(", "="):
            own.append(self.leaf())
        own.append(self.take("*"))
        if self.kind() == "[":
            name = self.node("computed_property_name", [self.need("["), self.expression(), self.need("]")])
        else:
            name = self.leaf({"string": "string", "number": "number"}.get(self.kind(), "property_identifier"))
        if self.word() in ("(", "<"):
            return self._rest("method_definition", [*own, name], name)
        if colon := self.take(":"):
            value = self.expression()
            return self.node("pair", [name, colon, value], key=name, value=value)
        name.type = "shorthand_property_identifier"
        if equals := self.take("="):
            return self.node("assignment_pattern", [name, equals, self.expression()], left=name)
        return name


def parse(text: str, toks: list[tuple[str, int, int]] | None = None) -> Node:
    """The tree of a text; SyntaxError where it can't be read."""
    try:
        return Parser(text, toks).program()
    except (IndexError, RecursionError) as e:
        raise SyntaxError(str(e)) from None


# -- many texts


def _words() -> frozenset[str]:
    """The names that the grammar tells from others, out of its code."""
    found, left = {a[1:] for a in dir(Parser) if a.startswith("_")}, [PREFIX, MODIFIERS, list(POWER), BEFORE_REGEX, *(f.__code__ for f in vars(Parser).values() if hasattr(f, "__code__"))]
    while left:
        x = left.pop()
        if isinstance(x, str):
            found.add(x)
        elif isinstance(x, (tuple, list, set, frozenset)):
            left.extend(x)
        elif hasattr(x, "co_consts"):
            left.extend(x.co_consts)
    return frozenset(found)


WORDS = _words()
#: Space and a token, or a text's end. Regular expressions and templates aren't read by it.
STEP = re.compile(r"((?:\s+|//[^\n]*|/\*.*?\*/)*)(?:" + re.sub(r"\?P<(\w+)>", "", TOKEN.pattern) + r"|\Z)", re.S)


def _stepped(text: str) -> tuple[tuple, list[tuple[str, int, int]]] | None:
    """(key, tokens) of a text, None if it may hold regular expressions or templates or can't be read."""
    if "`" in text or text.startswith("#!"):
        return None
    key, toks, at, words = [], [], 0, WORDS
    for space, name, number, string, punct in STEP.findall(text):
        at += len(space)
        if name:
            kind, seen, end = "name", name if name in words else "name", at + len(name)
        elif punct:
            kind = seen = punct
            end = at + len(punct)
        elif string or number:
            kind = seen = "string" if string else "number"
            end = at + len(string or number)
        else:
            break
        if kind == "/" or kind == "/=":
            return None
        key.append(seen + "\n" if "\n" in space else seen)
        toks.append((kind, at, end))
        at = end
    return (tuple(key), toks) if at == len(text) else None


class Shape:
    """A tree, its nodes, parents first, in all and by type, and what follows from the tree alone.

    A tree depends on its tokens' kinds, the grammar's own words and line ends only, so texts that differ in
    names, numbers, strings and space have one shape: the tree is moved from one text to the next."""

    def __init__(self, root: Node, toks: list[tuple[str, int, int]]):
        self.root, self.nodes = root, list(root.walk())
        self.by_type: dict[str, list[Node]] = {}
        for n in self.nodes:
            self.by_type.setdefault(n.type, []).append(n)
        first, last = {a: i for i, (_, a, _) in enumerate(toks)}, {b: i for i, (_, _, b) in enumerate(toks)}
        self.spans = [(n, first[n.start], last[n.end]) for n in self.nodes if n is not root]
        self.known: dict = {}

    def move(self, text: str, toks: list[tuple[str, int, int]]) -> None:
        for n, a, b in self.spans:
            n.start, n.end = toks[a][1], toks[b][2]
        self.root.end = len(text)

    def of(self, *types: str) -> list[Node]:
        """Nodes of some types, in order by type."""
        return [n for t in types for n in self.by_type.get(t, ())]

    def once(self, name: str, make):
        """What make gives for this shape."""
        if name not in self.known:
            self.known[name] = make()
        return self.known[name]


#: Nodes of shapes that a reader remembers.
REMEMBERED = 200_000


class Reader:
    """Reads one text after the other; what it gives for a text holds until the next."""

    def __init__(self):
        self.shapes: dict[tuple, Shape] = {}
        self.size = 0

    def read(self, text: str) -> Shape:
        stepped = _stepped(text)
        if stepped is None:
            toks = tokens(text)
            return Shape(parse(text, toks), toks)
        key, toks = stepped
        shape = self.shapes.get(key)
        if shape is None:
            shape = Shape(parse(text, toks), toks)
            self.size += len(shape.nodes)
            if self.size > REMEMBERED:
                self.shapes, self.size = {}, len(shape.nodes)
            self.shapes[key] = shape
        else:
            shape.move(text, toks)
        return shape
