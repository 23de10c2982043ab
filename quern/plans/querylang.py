"""The query language: terms, phrases, field filters, AND, OR, NOT, parentheses.

    expr := and ("OR"? and)*     and := unary ("AND" unary)*     unary := NOT unary | (expr) | "phrase" | field:value | term

The operator between clauses without one is OR unless chosen otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from quern.functions.text import analyze_word


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """kind: term, phrase, field, and, or, not.  A phrase's children are (term, offset)."""

    kind: str
    value: str = ""
    field: str = ""
    children: tuple = ()


def lex(query: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(query):
        c = query[i]
        if c.isspace():
            i += 1
        elif c in "()":
            out.append((c, c))
            i += 1
        elif c == '"':
            end = query.find('"', i + 1)
            end = len(query) if end < 0 else end
            out.append(("phrase", query[i + 1 : end]))
            i = end + 1
        else:
            j = i
            while j < len(query) and not query[j].isspace() and query[j] not in '()"':
                j += 1
            word, i = query[i:j], j
            head, colon, tail = word.partition(":")
            if word in ("AND", "OR", "NOT"):
                out.append((word, word))
            elif colon and head and tail:
                out.append(("field", word))
            else:
                out.append(("term", word))
    return out


class _Parser:
    def __init__(self, query: str, implicit: str, strict: bool, analyze: Callable[[str], list[str]]):
        self.tokens, self.at, self.implicit, self.analyze = lex(query), 0, implicit, analyze
        # strict: a phrase or field after an operand needs an operator
        self.starts = ("term", "(", "NOT") if strict else ("term", "(", "NOT", "phrase", "field")

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def combine(self, kind: str, parts: list) -> Node | None:
        parts = [p for p in parts if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else Node(kind, children=tuple(parts))

    def either(self) -> Node | None:
        parts = [self.both()]
        while self.peek() == "OR" or self.implicit == "OR" and self.peek() in self.starts:
            self.at += self.peek() == "OR"
            parts.append(self.both())
        return self.combine("or", parts)

    def both(self) -> Node | None:
        parts = [self.unary()]
        while self.peek() == "AND" or self.implicit == "AND" and self.peek() in self.starts:
            self.at += self.peek() == "AND"
            parts.append(self.unary())
        return self.combine("and", parts)

    def unary(self) -> Node | None:
        kind = self.peek()
        if not kind:
            raise QuerySyntaxError("unexpected end of query")
        text = self.tokens[self.at][1]
        if kind in ("AND", "OR"):
            raise QuerySyntaxError("missing operand before operator")
        if kind == ")":
            raise QuerySyntaxError("unexpected ')'")
        self.at += 1
        if kind == "NOT":
            inner = self.unary()
            return None if inner is None else Node("not", children=(inner,))
        if kind == "(":
            if self.peek() == ")":
                self.at += 1
                return None
            inner = self.either()
            if self.peek() != ")":
                raise QuerySyntaxError("missing closing parenthesis")
            self.at += 1
            return inner
        if kind == "phrase":
            return self.phrase(text)
        if kind == "field":
            field, _, value = text.partition(":")
            return Node("field", value=value, field=field)
        return self.combine("and", [Node("term", t) for t in self.analyze(text)])

    def phrase(self, text: str) -> Node | None:
        """Offsets follow the words: one that analyzes to nothing still takes a place."""
        parts, offset = [], 0
        for word in text.split():
            terms = self.analyze(word)
            for k, term in enumerate(terms):
                parts.append((term, offset + k))
            offset += len(terms) or 1
        if len(parts) < 2:
            return Node("term", parts[0][0]) if parts else None
        return Node("phrase", children=tuple(parts))


def parse(query: str, implicit: str = "OR", strict: bool = False, analyze: Callable[[str], list[str]] = analyze_word) -> Node | None:
    """The tree of a query; None if nothing is left of it (stop words, blanks)."""
    parser = _Parser(query, implicit, strict, analyze)
    if not parser.tokens:
        return None
    root = parser.either()
    if parser.at < len(parser.tokens):
        raise QuerySyntaxError("unexpected ')'")
    return root


def positive_terms(node: Node | None) -> list[str]:
    """Terms outside NOT, phrases' included, each once in order."""
    out: dict[str, None] = {}

    def walk(n: Node):
        if n.kind == "term":
            out[n.value] = None
        elif n.kind == "phrase":
            out.update(dict.fromkeys(t for t, _ in n.children))
        elif n.kind != "not":
            for c in n.children:
                walk(c)

    if node is not None:
        walk(node)
    return list(out)


def all_terms(node: Node) -> list[str]:
    if node.kind == "term":
        return [node.value]
    if node.kind == "phrase":
        return [t for t, _ in node.children]
    return [t for c in node.children for t in all_terms(c)]


def has_positive_filter(node: Node | None) -> bool:
    return node is not None and (node.kind == "field" or node.kind != "not" and any(has_positive_filter(c) for c in node.children if isinstance(c, Node)))
