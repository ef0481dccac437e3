"""A tolerant C front end in pure Python: text to a syntax tree with conventional node names.

A lexer and a recursive-descent parser with precedence climbing for expressions.  What cannot be parsed becomes an ``ERROR``
node that ends at the next semicolon or balanced brace, so one broken construct does not lose the rest of a file.  Preprocessor
lines give nodes of their own; conditional ones contain what stands between them.  No recursion depends on the length of a file; very
deep nesting is cut off into an ``ERROR`` node.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

MAX_DEPTH = 150
#: Tokens that are read, or forgotten, together.
CHUNK = 4096

TOKEN = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z)|//(?:\\\n|[^\n])*)
    |(?P<directive>^[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*)
    |(?P<space>\s+|\\\r?\n)
    |(?P<string>(?:u8|[uUL])?"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z))
    |(?P<char>[uUL]?'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))
    |(?P<number>\.?[0-9](?:[eEpP][+-]|[0-9a-zA-Z_.'])*)
    |(?P<name>[^\W\d]\w*)
    |(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^~!<>=?:;,.(){}\[\]])
    |(?P<other>.)""",
    re.S | re.X | re.M,
)
PRIMITIVE = frozenset("void char short int long float double signed unsigned bool _Bool size_t ssize_t intptr_t uintptr_t ptrdiff_t".split()) | frozenset(
    f"{sign}int{bits}_t" for sign in ("", "u") for bits in (8, 16, 32, 64)
)
SIZED = frozenset("short long signed unsigned".split())
STORAGE = frozenset("extern static auto register inline __inline typedef _Thread_local".split())
QUALIFIERS = frozenset("const volatile restrict _Atomic __restrict _Noreturn".split())
STATEMENTS = frozenset("if else for while do switch case default break continue return goto".split())
CONSTANTS = {"true": "true", "false": "false", "NULL": "null", "nullptr": "null"}
#: Binary operators by binding strength, weakest first.
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
STRENGTH = {op: k for k, ops in enumerate(LEVELS) for op in ops}
ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="))


@dataclass(slots=True)
class Node:
    """A named node; fields: the children with a role, by that role; calls: of a definition, see Parser."""

    kind: str
    children: list[Node] = field(default_factory=list)
    text: str = ""
    operator: str | None = None
    fields: dict[str, Node] = field(default_factory=dict)
    calls: list[str] = field(default_factory=list)
    parent: Node | None = field(default=None, repr=False, compare=False)
    index: int = 0

    def add(self, child: Node | None, role: str | None = None) -> Node:
        if child is not None:
            child.parent, child.index = self, len(self.children)
            self.children.append(child)
            if role:
                self.fields.setdefault(role, child)
        return self


@dataclass(slots=True, frozen=True)
class Token:
    kind: str
    text: str


def tokens(source: str) -> Iterator[Token]:
    return (Token(m.lastgroup or "other", m[0]) for m in TOKEN.finditer(source) if m.lastgroup not in ("space", "comment"))


class _Broken(Exception):
    pass


_END = Token("end", "")


class Parser:
    """Definitions and the names of direct calls are noted as they are completed, and forgotten again with what turns out broken.  Tokens are read
    as they are needed."""

    def __init__(self, source: str):
        self.tokens, self.more, self.at, self.depth = [], tokens(source), 0, 0
        self.typedefs: set[str] = set()
        self.definitions: list[Node] = []
        self.calls: list[str] = []

    # -- reading

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        while i >= len(self.tokens):
            new = list(islice(self.more, CHUNK))
            if not new:
                return _END
            self.tokens += new
        return self.tokens[i]

    def next(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def sees(self, *texts: str) -> bool:
        token = self.peek()
        return token.kind not in ("string", "char", "directive") and token.text in texts

    def take(self, text: str) -> bool:
        if self.sees(text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise _Broken(text)

    def leaf(self, kind: str) -> Node:
        return Node(kind, text=self.next().text)

    def name(self, kind: str = "identifier") -> Node:
        if self.peek().kind != "name":
            raise _Broken("name")
        return self.leaf(kind)

    # -- files

    def parse(self) -> Node:
        root = Node("translation_unit")
        self.items(root, lambda: self.peek() is _END, self.external)
        return root

    def items(self, into: Node, done, one) -> None:
        """Children by `one` until done; what cannot be parsed becomes an ERROR node.  Conditional directives nest."""
        open_: list[Node] = [into]
        while not done():
            self.item(open_, one)

    def item(self, open_: list[Node], one) -> None:
        if self.peek().kind == "directive":
            self.directive(open_)
            return
        start, definitions, calls = self.at, len(self.definitions), len(self.calls)
        try:
            open_[-1].add(one())
        except _Broken:
            self.at = start
            del self.definitions[definitions:], self.calls[calls:]
            open_[-1].add(self.skip())

    def outer(self) -> Iterator[tuple[list[int] | None, int, Node]]:
        """(key, place, definition) of each definition that lies in no other one, as items of the file are completed, of which none is held longer.
        The key is None for those that lie in no container either; these come in their order."""
        root = Node("translation_unit")
        open_ = [root]
        while self.peek() is not _END:
            self.item(open_, self.external)
            for d in self.definitions:
                above: list[Node] = []
                while (node := above[-1].parent if above else d.parent) is not None:
                    above.append(node)
                if not any(x.kind == "function_definition" for x in above):
                    yield [-x.index for x in above[-2::-1]] or None, d.index, d
            self.definitions.clear()
            self.calls.clear()
            if open_[-1].children:
                open_[-1].children[-1] = None  # what is complete goes, its place is kept
            if self.at >= CHUNK:
                del self.tokens[: self.at]
                self.at = 0

    def directive(self, open_: list[Node]) -> None:
        text = self.next().text.strip()[1:].strip()
        word = re.match(r"\w*", text)[0]
        rest = text[len(word) :].strip()
        if word in ("if", "ifdef", "ifndef"):
            node = Node("preproc_if" if word == "if" else "preproc_ifdef")
            node.add(Node("identifier", text=rest.split()[0]) if rest and word != "if" else Node("preproc_condition", text=rest), "name")
            open_[-1].add(node)
            open_.append(node)
        elif word in ("else", "elif", "elifdef", "elifndef") and len(open_) > 1:
            node = Node("preproc_else" if word == "else" else "preproc_elif")
            open_[-1].add(node)
            open_.append(node)
        elif word == "endif":
            while len(open_) > 1 and open_.pop().kind not in ("preproc_if", "preproc_ifdef"):
                pass
        elif word == "include":
            open_[-1].add(Node("preproc_include").add(Node("system_lib_string" if rest.startswith("<") else "string_literal", text=rest)))
        elif word == "define":
            m = re.match(r"(\w+)(\([^)]*\))?\s*(.*)", rest, re.S)
            node = Node("preproc_function_def" if m and m[2] else "preproc_def")
            if m:
                node.add(Node("identifier", text=m[1]), "name")
                if m[2]:
                    node.add(Node("preproc_params", [Node("identifier", text=x.strip()) for x in m[2][1:-1].split(",") if re.match(r"\s*\w+\s*$", x)]))
                if m[3].strip():
                    node.add(Node("preproc_arg", text=m[3].strip()))
            open_[-1].add(node)
        else:
            open_[-1].add(Node("preproc_call").add(Node("preproc_directive", text=word)))

    def skip(self) -> Node:
        """Everything up to the next semicolon, or through the next balanced braces, at this level."""
        node, level = Node("ERROR"), 0
        while (token := self.peek()) is not _END:
            plain = token.kind == "op"
            if plain and token.text == "}" and level == 0:
                if not node.text:
                    self.next()
                break
            node.text += self.next().text + " "
            if plain and token.text == "{":
                level += 1
            elif plain and token.text == "}":
                level -= 1
                if level == 0:
                    break
            elif plain and token.text == ";" and level == 0:
                break
        return node

    # -- declarations

    def external(self) -> Node | None:
        if self.take(";"):
            return None
        if self.sees("extern") and self.peek(1).kind == "string":
            self.next()
            node = Node("linkage_specification").add(self.string())
            return node.add(self.declaration_list() if self.sees("{") else self.external())
        return self.declaration(True)

    def declaration_list(self) -> Node:
        self.need("{")
        node = Node("declaration_list")
        self.items(node, lambda: self.sees("}") or self.peek() is _END, self.external)
        self.take("}")
        return node

    def specifiers(self, into: Node, bare: bool = False) -> bool:
        """Storage classes, qualifiers and one type; false if there is no type."""
        found = False
        while True:
            token = self.peek()
            if token.kind != "name":
                return found
            if token.text in STORAGE:
                into.add(self.leaf("storage_class_specifier"))
            elif token.text in QUALIFIERS:
                into.add(self.leaf("type_qualifier"))
            elif token.text in ("__attribute__", "__declspec", "_Alignas"):
                self.next()
                self.balanced()
            elif token.text in ("struct", "union", "enum") and not found:
                into.add(self.compound_type(), "type")
                found = True
            elif token.text in SIZED and not found:
                sized = Node("sized_type_specifier")
                while self.peek().kind == "name" and (self.peek().text in SIZED or self.peek().text in PRIMITIVE):
                    if self.next().text not in SIZED:
                        sized.add(Node("primitive_type", text=self.tokens[self.at - 1].text), "type")
                into.add(sized, "type")
                found = True
            elif token.text in PRIMITIVE and not found:
                into.add(self.leaf("primitive_type"), "type")
                found = True
            elif not found and token.text not in STATEMENTS and (bare or self.looks_like_type()):
                into.add(self.leaf("type_identifier"), "type")
                found = True
            else:
                return found

    def looks_like_type(self) -> bool:
        """Of a name: whether a declarator follows, so that it names a type."""
        if self.peek().text in self.typedefs:
            return True
        k = 1
        while self.peek(k).text == "*" or self.peek(k).text in QUALIFIERS:
            k += 1
        after = self.peek(k)
        if after.kind != "name" or after.text in STATEMENTS:
            return False
        return k == 1 or self.peek(k + 1).text in ("=", ";", ",", ")", "[", "(", ":")

    def balanced(self) -> None:
        if not self.sees("("):
            return
        level = 0
        while (token := self.next()) is not _END:
            level += (token.text == "(") - (token.text == ")")
            if level == 0:
                return

    def compound_type(self) -> Node:
        word = self.next().text
        node = Node(f"{word}_specifier")
        if self.peek().kind == "name":
            node.add(self.name("type_identifier"), "name")
        if self.take("{"):
            if word == "enum":
                body = Node("enumerator_list")
                while not self.sees("}") and self.peek() is not _END:
                    item = Node("enumerator").add(self.name(), "name")
                    if self.take("="):
                        item.add(self.ternary(), "value")
                    body.add(item)
                    if not self.take(","):
                        break
            else:
                body = Node("field_declaration_list")
                self.items(body, lambda: self.sees("}") or self.peek() is _END, self.field_declaration)
            self.need("}")
            node.add(body, "body")
        return node

    def field_declaration(self) -> Node | None:
        if self.take(";"):
            return None
        node = Node("field_declaration")
        if not self.specifiers(node, True):
            raise _Broken("type")
        while not self.sees(";"):
            if not self.sees(":"):
                node.add(self.declarator("field_identifier"), "declarator")
            if self.take(":"):
                node.add(Node("bitfield_clause").add(self.ternary()))
            if not self.take(","):
                break
        self.need(";")
        return node

    def declaration(self, outside: bool = False) -> Node:
        node, calls = Node("declaration"), len(self.calls)
        is_type = self.sees("typedef")
        typed = self.specifiers(node, outside and self.peek(1).text != "(")
        if not typed and not outside:
            raise _Broken("type")
        if self.take(";"):
            spec = node.children[0] if len(node.children) == 1 else node
            return spec
        first = True
        while True:
            d = self.declarator("type_identifier" if is_type else "identifier")
            if first and self.sees("{") and _is_function(d):
                return self.define(node, d, calls)
            if first and _is_function(d) and self.peek().kind == "name":  # parameters declared in the old style
                while not self.sees("{", ";") and self.peek() is not _END:
                    node.add(self.declaration())
                return self.define(node, d, calls)
            if not typed:
                raise _Broken("type")
            if is_type:
                node.kind = "type_definition"
                self.typedefs.add(_declared(d))
            first = False
            if self.take("="):
                d = Node("init_declarator").add(d, "declarator").add(self.initializer(), "value")
            node.add(d, "declarator")
            if not self.take(","):
                break
        self.need(";")
        return node

    def define(self, node: Node, declarator: Node, calls: int) -> Node:
        """A definition; its calls are those completed since `calls`, the last one first."""
        node.kind = "function_definition"
        node.add(declarator, "declarator").add(self.block(), "body")
        node.calls = self.calls[calls:][::-1]
        self.definitions.append(node)
        return node

    def declarator(self, leaf: str, abstract: bool = False) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.depth -= 1
            raise _Broken("depth")
        try:
            if self.take("*"):
                node = Node("abstract_pointer_declarator" if abstract else "pointer_declarator")
                while self.peek().text in QUALIFIERS:
                    node.add(self.leaf("type_qualifier"))
                if abstract and not self.sees("*", "(", "["):
                    if self.peek().kind != "name":
                        return node
                    node.kind = "pointer_declarator"
                return node.add(self.declarator(leaf, abstract), "declarator")
            if self.sees("(") and (self.peek(1).text in ("*", "(") or not abstract and self.peek(1).kind == "name"):
                self.next()
                node = Node("parenthesized_declarator").add(self.declarator(leaf, abstract), "declarator")
                self.need(")")
            elif self.peek().kind == "name" and self.peek().text not in STATEMENTS:
                node = self.name(leaf)
            elif abstract:
                node = None
            else:
                raise _Broken("declarator")
            while True:
                if self.take("["):
                    array = Node("abstract_array_declarator" if node is None else "array_declarator").add(node, "declarator")
                    while self.peek().text in QUALIFIERS or self.sees("static"):
                        array.add(self.leaf("type_qualifier"))
                    if not self.sees("]"):
                        array.add(self.expression(), "size")
                    self.need("]")
                    node = array
                elif self.sees("("):
                    node = Node("abstract_function_declarator" if node is None else "function_declarator").add(node, "declarator").add(self.parameters(), "parameters")
                elif self.sees("__attribute__", "__asm__", "asm"):
                    self.next()
                    self.balanced()
                else:
                    break
            if node is None:
                raise _Broken("declarator")
            return node
        finally:
            self.depth -= 1

    def parameters(self) -> Node:
        self.need("(")
        node = Node("parameter_list")
        while not self.sees(")"):
            if self.take("..."):
                node.add(Node("variadic_parameter"))
            else:
                p = Node("parameter_declaration")
                if not self.specifiers(p, True):
                    raise _Broken("parameter")
                if not self.sees(",", ")"):
                    p.add(self.declarator("identifier", True), "declarator")
                # a lone name is the name of an old-style parameter
                node.add(p)
            if not self.take(","):
                break
        self.need(")")
        return node

    def initializer(self) -> Node:
        if not self.sees("{"):
            return self.assignment()
        self.next()
        node = Node("initializer_list")
        while not self.sees("}"):
            if self.sees(".", "["):
                pair = Node("initializer_pair")
                while self.sees(".", "["):
                    if self.take("."):
                        pair.add(Node("field_designator").add(self.name("field_identifier")), "designator")
                    else:
                        self.next()
                        pair.add(Node("subscript_designator").add(self.expression()), "designator")
                        self.need("]")
                self.need("=")
                node.add(pair.add(self.initializer(), "value"))
            else:
                node.add(self.initializer())
            if not self.take(","):
                break
        self.need("}")
        return node

    def type_name(self) -> Node:
        node = Node("type_descriptor")
        if not self.specifiers(node, True):
            raise _Broken("type")
        if not self.sees(")", ","):
            node.add(self.declarator("identifier", True), "declarator")
        return node

    # -- statements

    def block(self) -> Node:
        self.need("{")
        node = Node("compound_statement")
        self.items(node, lambda: self.sees("}") or self.peek() is _END, self.statement)
        self.take("}")
        return node

    def statement(self) -> Node | None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.depth -= 1
            raise _Broken("depth")
        try:
            return self._statement()
        finally:
            self.depth -= 1

    def condition(self) -> Node:
        self.need("(")
        node = Node("parenthesized_expression").add(self.expression())
        self.need(")")
        return node

    def body(self) -> Node:
        return self.statement() or Node("expression_statement")

    def _statement(self) -> Node | None:
        token = self.peek()
        if self.sees("{"):
            return self.block()
        if self.take(";"):
            return Node("expression_statement")
        if token.kind == "name":
            word = token.text
            if word in ("if", "while", "switch"):
                self.next()
                node = Node(f"{word}_statement").add(self.condition(), "condition").add(self.body(), "consequence" if word == "if" else "body")
                if word == "if" and self.take("else"):
                    node.add(Node("else_clause").add(self.body()), "alternative")
                return node
            if word == "do":
                self.next()
                node = Node("do_statement").add(self.body(), "body")
                self.need("while")
                node.add(self.condition(), "condition")
                self.need(";")
                return node
            if word == "for":
                self.next()
                self.need("(")
                node = Node("for_statement")
                if not self.take(";"):
                    if self.starts_declaration():
                        node.add(self.declaration(), "initializer")
                    else:
                        node.add(self.comma(), "initializer")
                        self.need(";")
                if not self.sees(";"):
                    node.add(self.comma(), "condition")
                self.need(";")
                if not self.sees(")"):
                    node.add(self.comma(), "update")
                self.need(")")
                return node.add(self.body(), "body")
            if word in ("break", "continue"):
                self.next()
                self.need(";")
                return Node(f"{word}_statement")
            if word == "return":
                self.next()
                node = Node("return_statement")
                if not self.sees(";"):
                    node.add(self.comma())
                self.need(";")
                return node
            if word == "goto":
                self.next()
                node = Node("goto_statement").add(self.name("statement_identifier"), "label")
                self.need(";")
                return node
            if word in ("case", "default"):
                self.next()
                node = Node("case_statement")
                if word == "case":
                    node.add(self.ternary(), "value")
                    if self.take("..."):
                        node.add(self.ternary())
                self.need(":")
                self.items(node, lambda: self.sees("case", "default", "}") or self.peek() is _END, self.statement)
                return node
            if self.peek(1).text == ":" and self.peek(1).kind == "op" and word not in STATEMENTS:
                node = Node("labeled_statement").add(self.name("statement_identifier"), "label")
                self.need(":")
                return node.add(None if self.sees("}") else self.statement())
            if self.starts_declaration():
                return self.declaration()
        node = Node("expression_statement").add(self.comma())
        self.need(";")
        return node

    def starts_declaration(self) -> bool:
        token = self.peek()
        if token.kind != "name":
            return False
        w = token.text
        return w in PRIMITIVE or w in SIZED or w in STORAGE or w in QUALIFIERS or w in ("struct", "union", "enum") or w not in STATEMENTS and self.looks_like_type()

    # -- expressions

    def comma(self) -> Node:
        left = self.assignment()
        while self.take(","):
            left = Node("comma_expression").add(left, "left").add(self.assignment(), "right")
        return left

    expression = comma

    def assignment(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.depth -= 1
            raise _Broken("depth")
        try:
            left = self.ternary()
            if self.peek().kind == "op" and self.peek().text in ASSIGN:
                op = self.next().text
                right = self.initializer() if self.sees("{") else self.assignment()
                return Node("assignment_expression", operator=op).add(left, "left").add(right, "right")
            return left
        finally:
            self.depth -= 1

    def ternary(self) -> Node:
        test = self.binary()
        if not self.take("?"):
            return test
        node = Node("conditional_expression").add(test, "condition")
        if not self.sees(":"):
            node.add(self.comma(), "consequence")
        self.need(":")
        return node.add(self.ternary(), "alternative")

    def binary(self) -> Node:
        """Operators by precedence, with a stack of operands instead of recursion."""
        operands, operators = [self.unary()], []

        def fold():
            right, op = operands.pop(), operators.pop()
            operands[-1] = Node("binary_expression", operator=op).add(operands[-1], "left").add(right, "right")

        while self.peek().kind == "op" and self.peek().text in STRENGTH:
            op = self.next().text
            while operators and STRENGTH[operators[-1]] >= STRENGTH[op]:
                fold()
            operators.append(op)
            operands.append(self.unary())
        while operators:
            fold()
        return operands[0]

    def unary(self) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.depth -= 1
            raise _Broken("depth")
        try:
            token = self.peek()
            if token.kind == "op":
                if token.text in ("++", "--"):
                    self.next()
                    return Node("update_expression", operator=token.text).add(self.unary(), "argument")
                if token.text in ("*", "&"):
                    self.next()
                    return Node("pointer_expression", operator=token.text).add(self.unary(), "argument")
                if token.text in ("-", "+", "!", "~"):
                    self.next()
                    return Node("unary_expression", operator=token.text).add(self.unary(), "argument")
                if token.text == "(" and self.is_cast():
                    self.next()
                    kind = self.type_name()
                    self.need(")")
                    if self.sees("{"):
                        return self.postfix(Node("compound_literal_expression").add(kind, "type").add(self.initializer(), "value"))
                    return Node("cast_expression").add(kind, "type").add(self.unary(), "value")
            elif token.kind == "name" and token.text in ("sizeof", "_Alignof", "alignof"):
                self.next()
                node = Node("sizeof_expression" if token.text == "sizeof" else "alignof_expression")
                if self.sees("(") and self.is_cast():
                    self.next()
                    node.add(self.type_name(), "type")
                    self.need(")")
                    return node
                return node.add(self.unary(), "value")
            return self.postfix(self.primary())
        finally:
            self.depth -= 1

    def is_cast(self) -> bool:
        """At an opening bracket: whether a type stands in it."""
        first = self.peek(1)
        if first.kind != "name":
            return False
        if first.text in PRIMITIVE or first.text in SIZED or first.text in QUALIFIERS or first.text in ("struct", "union", "enum") or first.text in self.typedefs:
            return True
        k = 2
        while self.peek(k).text == "*":
            k += 1
        if self.peek(k).text != ")":
            return False
        after = self.peek(k + 1)
        return k > 2 and (after.kind in ("name", "number", "string", "char") or after.text in ("(", "&", "*")) or k == 2 and after.kind in ("name", "number", "string", "char") and after.text not in STATEMENTS

    def postfix(self, node: Node) -> Node:
        while True:
            if self.take("("):
                arguments = Node("argument_list")
                while not self.sees(")"):
                    arguments.add(self.type_name() if self.starts_argument_type() else self.assignment())
                    if not self.take(","):
                        break
                self.need(")")
                if node.kind == "identifier":
                    self.calls.append(node.text)
                node = Node("call_expression").add(node, "function").add(arguments, "arguments")
            elif self.take("["):
                node = Node("subscript_expression").add(node, "argument").add(self.comma(), "index")
                self.need("]")
            elif self.sees(".", "->"):
                op = self.next().text
                node = Node("field_expression", operator=op).add(node, "argument").add(self.name("field_identifier"), "field")
            elif self.sees("++", "--"):
                node = Node("update_expression", operator=self.next().text).add(node, "argument")
            else:
                return node

    def starts_argument_type(self) -> bool:
        token = self.peek()
        return token.kind == "name" and (token.text in PRIMITIVE or token.text in SIZED or token.text in ("struct", "union", "enum"))

    def string(self) -> Node:
        text = self.next().text
        node = Node("string_literal", text=text)
        body = text[text.index('"') + 1 :].removesuffix('"')
        for part in re.findall(r"\\(?:x[0-9a-fA-F]+|[0-7]{1,3}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)|[^\\]+", body, re.S):
            node.add(Node("escape_sequence" if part[0] == "\\" else "string_content", text=part))
        return node

    def primary(self) -> Node:
        token = self.peek()
        if token.kind == "number":
            return self.leaf("number_literal")
        if token.kind == "char":
            text = self.next().text
            body = text[text.index("'") + 1 :].removesuffix("'")
            return Node("char_literal", [Node("escape_sequence" if body[:1] == "\\" else "character", text=body)] if body else [], text)
        if token.kind == "string":
            first = self.string()
            if self.peek().kind != "string":
                return first
            many = Node("concatenated_string").add(first)
            while self.peek().kind == "string":
                many.add(self.string())
            return many
        if token.kind == "name" and token.text not in STATEMENTS:
            return self.leaf(CONSTANTS.get(token.text, "identifier"))
        if self.take("("):
            if self.sees("{"):
                node = Node("parenthesized_expression").add(self.block())
            else:
                node = Node("parenthesized_expression").add(self.comma())
            self.need(")")
            return node
        raise _Broken("expression")


def _is_function(node: Node | None) -> bool:
    while node is not None:
        if node.kind == "function_declarator":
            return True
        node = node.fields.get("declarator")
    return False


def _declared(node: Node | None) -> str:
    while node is not None and "declarator" in node.fields:
        node = node.fields["declarator"]
    return node.text if node is not None else ""


def parse_c(source: str) -> Node:
    return Parser(source).parse()


def outer_definitions[T](source: str, made: Callable[[Node], T] = lambda d: d) -> Iterator[T]:
    """What is made of each definition that lies in no other one.  The order key is the place of the container, the later of two siblings first and
    a container before those in it; then the place in the container.  So those in no container come first, as they are parsed; the others are held."""
    held = []
    for key, place, d in Parser(source).outer():
        if key is None:
            yield made(d)
        else:
            held.append((key, place, made(d)))
    yield from (x for _, _, x in sorted(held, key=lambda x: x[:2]))
